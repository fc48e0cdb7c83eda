"""Root causes against a plain walk over whole histories, partial results, and runs of several drivers at once."""

from __future__ import annotations

import json
import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from syslumen.operators import analysis, jobs, rca

START = datetime(2026, 4, 15, 10)
KINDS = [("IFNET", "IF_DOWN"), ("BFD", "BFD_SESS_DOWN"), ("BGP", "PEER_BACKWARD"), ("OSPF", "NBR_CHG"), ("RM", "ROUTE_DELETE"), ("OPTICAL", "MY_OPTICAL_POWER"), ("ETHBASE", "CRC_ERR"), ("BFD", "SESS_UP"), ("DEVM", "NORMAL")]


def logs(spark, rows):
    """Rows of (id, seconds, device, module, brief, severity, parameters)."""
    made = [(i, d, START + timedelta(seconds=s), f"h{d}", "f", m, b, v, p) for i, s, d, m, b, v, p in rows]
    df = spark.createDataFrame(made, "id bigint, device_id bigint, t timestamp, hostname string, source_file string, module string, brief string, severity int, parameters_json string")
    return df.withColumn("timestamp", F.col("t").cast("timestamp_ntz")).repartition(3)


def plain(rows, rules=rca.RULES, nodes=rca.NODES):
    """All windows one after the other over all subjects, as the order of claims is defined."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    own = lambda p: rca.entities(p)
    claimed, out, k, window = set(), [], 0, 0
    while k < len(rows):
        start = rows[k][1]
        inside = [r for r in rows if start <= r[1] <= start + 300]
        for root in inside:
            edges = [e for e in rules if rca.starts(e, root[3], root[4])]
            if root[0] in claimed or not edges or rca._RECOVERY.search(root[4]):
                continue
            queue, seen, found = [root], {root[0]}, []
            while queue and (nodes is None or len(found) < nodes):
                at = queue.pop(0)
                for e in (e for e in rules if rca.starts(e, at[3], at[4])):
                    for b in e.to_briefs:
                        for m in e.to_modules:
                            for r in inside:
                                if (r[3], r[4]) != (m, b) or r[2] != root[2] or r[0] in seen or (r[1], r[0]) <= (at[1], at[0]) or r[1] > root[1] + 300 or rca._RECOVERY.search(r[4]) or (nodes is not None and len(found) >= nodes):
                                    continue
                                mine, its = own(at[6]), own(r[6])
                                if any(mine[n] != its[n] for n in mine.keys() & its.keys()) or r[0] in claimed:
                                    continue
                                seen.add(r[0])
                                found.append((r[0], at[0]))
                                queue.append(r)
            if found:
                claimed |= seen
                out.append((window, root[0], tuple(found)))
        window += 1
        k = next((j for j in range(k + 1, len(rows)) if rows[j][1] >= start + 240), len(rows))
    return out


def told(df):
    rows = df.collect()
    return sorted((r["window"], r["root_id"], tuple((i["log_id"], i["from_log_id"]) for i in r["impacts"])) for r in rows)


def unrest(n, seconds, seed, devices=3):
    rng = random.Random(seed)
    params = ["{}", json.dumps({"Interface": "GE1"}), json.dumps({"IfName": "GE2"}), ""]
    return [(k + 1, rng.randint(0, seconds), rng.randint(1, devices), *rng.choice(KINDS), rng.randint(1, 8), rng.choice(params)) for k in range(n)]


@pytest.mark.parametrize(("n", "seconds", "nodes", "block"), [(300, 6000, 500, 16), (260, 3000, 3, 1), (300, 4000, None, 1), (300, 20000, None, 2)])
def test_blocks_give_what_one_walk_gives(spark, monkeypatch, n, seconds, nodes, block):
    monkeypatch.setattr(rca, "BLOCK", block)
    monkeypatch.setattr(rca, "ROWS", 0)
    rows = unrest(n, seconds, n + seconds)
    want = plain(rows, nodes=nodes)
    assert len(want) > 5
    assert told(rca.analyse(logs(spark, rows), most_nodes=nodes)) == sorted(want)


def test_claims_that_pass_through_all_windows(spark, monkeypatch):
    """Each window's only root is claimed by the one before it unless that was claimed itself."""
    monkeypatch.setattr(rca, "BLOCK", 1)
    monkeypatch.setattr(rca, "ROWS", 0)
    rules = rca.rule("r", ("A", "X", "B", "Y"), ("B", "Y", "A", "Z"), ("A", "Z", "B", "Y"))
    rows = [(k + 1, 200 * k, 1, *(("A", "X") if k == 0 else ("B", "Y") if k % 2 else ("A", "Z")), 4, "{}") for k in range(60)]
    assert told(rca.analyse(logs(spark, rows), rules)) == sorted(plain(rows, rules))


def test_a_storm_is_explained_whole(spark):
    rows = [(1, 0, 1, "IFNET", "IF_DOWN", 4, "{}")] + [(k, 1 + k % 200, 1, *random.Random(k).choice(KINDS[1:4]), 4, "{}") for k in range(2, 3002)]
    found = rca.analyse(logs(spark, rows), most_nodes=None).collect()
    assert len(found) == 1 and found[0]["n_impacts"] == 3000
    assert rca.analyse(logs(spark, rows)).collect()[0]["n_impacts"] == rca.NODES


def test_a_root_is_tried_again_in_the_next_window(spark):
    rows = [(100, 0, 1, "DEVM", "NORMAL", 4, "{}"), (1, 280, 1, *KINDS[0], 4, "{}"), (2, 310, 1, *KINDS[1], 4, "{}"), (3, 320, 1, *KINDS[3], 4, "{}"), (4, 330, 1, "BGP", "PEER_DOWN", 4, "{}"), (5, 340, 1, *KINDS[4], 4, "{}"), (101, 650, 1, "DEVM", "NORMAL", 4, "{}")]
    found = rca.analyse(logs(spark, rows)).collect()
    assert [(r["root_id"], r["correlated_ids"]) for r in found] == [(1, [1, 2, 3, 4, 5])]


def test_partial_results_are_a_prefix_and_go_on(spark, tmp_path, monkeypatch):
    rows = unrest(300, 12000, 5)
    own, want = logs(spark, rows), sorted(plain(rows))
    work = analysis.Analysis(spark, str(tmp_path / "a"), windows=8)
    settle, calls = work._settle, []

    def stop_after_two(k, until):
        calls.append(k)
        if len(calls) == 3:
            # a job that runs is interrupted by its tag
            threading.Timer(0.5, work.cancel, ("TIMEOUT",)).start()
            spark.range(1 << 34).selectExpr("sum(id % 7)").collect()
        return settle(k, until)

    monkeypatch.setattr(work, "_settle", stop_after_two)
    part = work.run(own)
    assert part.truncated and part.error == analysis.TIMEOUT
    got = told(part.events)
    assert 0 < len(got) < len(want) and got == want[: len(got)]
    until = part.analyzed_until / 1e6
    assert min(w[0] for w in want[len(got) :]) >= 16 and until <= (START + timedelta(seconds=12000) - datetime(1970, 1, 1)).total_seconds()
    # another driver goes on where this one stopped
    whole = analysis.Analysis(spark, str(tmp_path / "a"), windows=8).run(own)
    assert not whole.truncated and whole.error is None and told(whole.events) == want
    last = max(r[1] for r in rows)
    assert whole.analyzed_until == int((START + timedelta(seconds=last) - datetime(1970, 1, 1)).total_seconds() * 1e6)


def test_no_time_and_few_events(spark, tmp_path):
    own = logs(spark, unrest(200, 8000, 9))
    stopped = analysis.Analysis(spark, str(tmp_path / "none"))
    stopped.cancel()
    none = stopped.run(own)
    assert none.truncated and none.error == analysis.CANCELLED and none.events.count() == 0
    none = analysis.Analysis(spark, str(tmp_path / "none")).run(own, limit_s=0.0)
    assert none.truncated and none.error == analysis.TIMEOUT and none.events.count() == 0 and none.analyzed_until is None
    few = analysis.Analysis(spark, str(tmp_path / "few"), windows=4).run(own, most_events=3)
    assert few.truncated and few.error == analysis.EVENT_CAP and few.events.count() == 3
    nothing = analysis.Analysis(spark, str(tmp_path / "nothing")).run(own.where("id < 0"))
    assert not nothing.truncated and nothing.events.count() == 0


def test_two_drivers_and_one_task(spark, tmp_path):
    """Of many that ask at once one works; two tasks work side by side, and no more than two."""
    seen, lock, together = [], threading.Lock(), []
    both = threading.Barrier(2)

    def work(name, gate=None):
        def inner():
            with lock:
                seen.append(name)
                together.append(len(seen))
            if gate:
                gate.wait(60)
        return inner

    path = str(tmp_path / "jobs")
    threads = [threading.Thread(target=jobs.Jobs(spark, path).run, args=("one", work("one"))) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    own = jobs.Jobs(spark, path)
    assert seen == ["one"] and own.state("one") == jobs.COMPLETED
    seen.clear()
    threads = [threading.Thread(target=jobs.Jobs(spark, path).run, args=(n, work(n, both))) for n in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    # both had to be at work at once to pass the barrier
    assert sorted(seen) == ["a", "b"] and own.state("a") == own.state("b") == jobs.COMPLETED


def test_runs_at_once_are_bounded(spark, tmp_path):
    now, most, lock = [0], [0], threading.Lock()
    path = str(tmp_path / "jobs")

    def work():
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        threading.Event().wait(0.4)
        with lock:
            now[0] -= 1

    threads = [threading.Thread(target=jobs.Jobs(spark, path, most=2, lease_s=5).run, args=(f"t{k}", work)) for k in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert most[0] == 2 and {r["state"] for r in jobs.states(jobs.Jobs(spark, path).changes()).collect()} == {jobs.COMPLETED}


def test_a_lost_driver_is_told_by_its_lease(spark, tmp_path):
    own = jobs.Jobs(spark, str(tmp_path / "jobs"), lease_s=0.4)
    run = own.claim("lost")
    own._mark("lost", run, jobs.RUNNING)
    alive = threading.Event()
    worker = threading.Thread(target=own.run, args=("alive", lambda: alive.wait(60)))
    worker.start()
    threading.Event().wait(1.2)
    assert own.recover(lost=True) == 1 and own.state("lost") == jobs.FAILED and own.state("alive") == jobs.RUNNING
    # its end comes too late to count
    assert not own._mark("lost", run, jobs.COMPLETED) and own.run("lost", lambda: None) == jobs.COMPLETED
    alive.set()
    worker.join()
    assert own.state("alive") == jobs.COMPLETED


def test_a_limited_analysis_ends_its_job_by_time(spark, tmp_path):
    own = logs(spark, unrest(50, 2000, 4))

    def work():
        found = analysis.Analysis(spark, str(tmp_path / "a")).run(own, limit_s=0.0)
        if found.error == analysis.TIMEOUT:
            raise TimeoutError("analysed in part")

    assert jobs.Jobs(spark, str(tmp_path / "jobs")).run("x", work) == jobs.TIMEOUT
