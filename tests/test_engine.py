"""Behaviour that the queries over the log view don't show."""

from __future__ import annotations

import bisect
import io
import random
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from syslumen.functions import parameters as P
from syslumen.operators import matching, rca, tags, timeline, windows
from syslumen.plans import filters as FL
from syslumen.session import micros
from syslumen.sinks import export
from syslumen.sources import logview as L
from syslumen.sources import package, raw
from syslumen.streaming import ingest

SF = os.environ.get("SYSLUMEN_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def logs(spark):
    return L.logs(spark, SF)


@pytest.mark.parametrize(("field", "op", "value"), [("nope", "eq", "x"), ("module", "kv_eq", "k=1"), ("severity", "lt", "x"), ("raw_log", "regex", "(("), ("parameters", "kv_eq", "no pair"), ("parameters", "kv_eq", "$k=1"), ("brief", "eq", "x" * 257), ("tag", "has_any", "x")])
def test_bad_conditions_are_told(spark, logs, field, op, value):
    with pytest.raises(FL.FilterError):
        FL.apply(logs, FL.LogFilter(conditions=[FL.Condition(field, op, value)]), L.relations(spark, SF))


def test_filter_limits(spark, logs):
    with pytest.raises(FL.FilterError):
        FL.apply(logs, FL.LogFilter(conditions=[FL.Condition("severity", "lte", "3")] * 16))
    with pytest.raises(FL.FilterError):
        FL.apply(logs, FL.LogFilter(untagged_only=True, tag_ids=[1]), L.relations(spark, SF))
    with pytest.raises(FL.FilterError):
        FL.page(logs, after_id=3)
    with pytest.raises(FL.FilterError):
        FL.export_rows(logs, 10)


def test_and_is_within_each_condition_and_pages_make_the_whole(logs):
    a, b = FL.Condition("module", "eq", "BGP"), FL.Condition("severity", "lte", "4")
    ids = lambda *c: {r["id"] for r in FL.apply(logs, FL.LogFilter(conditions=list(c))).select("id").collect()}
    assert ids(a, b) == ids(a) & ids(b)
    whole = [r["id"] for r in FL.order(logs, "id").select("id").collect()]
    by_page = [r["id"] for k in range(1, 5) for r in FL.page(logs, k, 300, "id").collect()]
    by_key, last = [], 0
    while got := [r["id"] for r in (FL.page(logs, 1, 300, "id", after_id=last) if last else FL.page(logs, 1, 300, "id")).collect()]:
        by_key += got
        last = got[-1]
    assert whole == by_page == by_key


def test_simple_filters_reach_the_scan(spark):
    plan = FL.apply(L.logs(spark, SF), FL.LogFilter(exclude_comment=True)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "raw_log" not in plan and "props" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("text (a=1, b-c=x y, PeerAddr=10.0.0.1)", {"a": "1", "b-c": "x y", "PeerAddr": "10.0.0.1"}),
        ("type=flood, src=10.0.0.1", {"type": "flood", "src": "10.0.0.1"}),
        ("[WLAN_STA_INFO]ACMAC:aa-bb;SSID:guest net;RSSI:-60", {"WLAN_STA_INFO": "", "ACMAC": "aa-bb", "SSID": "guest net", "RSSI": "-60"}),
        ("(a=[1 2], b=\"q, r\", c=(n), d=)", {"a": "1 2", "b": "q, r", "c": "n", "d": ""}),
        ("(a=1, a=2, a=1)", {"a": '["1", "2"]'}),
        ("nothing here", {}),
    ],
)
def test_parameters(body, want):
    assert P.extract(body) == want


def test_templates():
    compiled = {}
    assert P.capture("Interface [IfName] changed. (State=[State], User=[User])", "Interface GE0/0/1 changed. (State=down, User=x y)", compiled) == {"IfName": "GE0/0/1", "State": "down", "User": "x y"}
    assert P.capture("no places", "no places", compiled) == {}
    assert P.render("[If-Name] is {state}, %x% and $missing", {"ifname": "GE1", "State": "down", "x": "-"}) == "GE1 is down, %x% and $missing"


def test_files_in_other_encodings_and_long_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbfone\r\ntwo\n\x00\x00\n")
    (tmp_path / "b.log").write_bytes("接口 down\n".encode("gb18030"))
    (tmp_path / "c.log").write_bytes(b"x" * (raw.LONGEST_LINE + 1) + b"\nshort\n")
    lines = raw.clean_lines(raw.read_lines(spark, [str(tmp_path)], "*.log"))
    assert sorted((r["source_file"], r["seq"], r["line"]) for r in lines.collect()) == [("a.log", 0, "one"), ("a.log", 1, "two"), ("b.log", 0, "接口 down")]


def test_ids_follow_files_and_lines(spark):
    rows = spark.createDataFrame([("b", 0), ("a", 0), ("a", 1), ("b", 1)], "source_file string, seq bigint")
    assert {(r["source_file"], r["seq"]): r["id"] for r in raw.numbered(rows).collect()} == {("a", 0): 1, ("a", 1): 2, ("b", 0): 3, ("b", 1): 4}


PROFILE = "<profile><libId>L1</libId><libName>Lib</libName><productType>NE40E</productType><productVersion>V8</productVersion></profile>"
NAVI = "<navi><topic txt='BGP日志'><topic txt='BGP/4/PEER_DOWN' url='../pages/p%201.html' id='t1'/></topic><topic txt='IFNET告警'><topic txt='告警 hwIfDown' url='../pages/a.html#x' id='t2'/><topic txt='other' url='../../../etc/passwd' id='t3'/></topic></navi>"
LOG_PAGE = "<html><head><title>T</title></head><body><h1>BGP/4/PEER_DOWN</h1><h2>日志信息</h2><p>Peer [Peer] is&nbsp;down.</p><h2>可能原因</h2><p>Line.</p><p>Peer.</p><script>x</script></body></html>"


def test_zip_and_directory_give_the_same(spark, tmp_path):
    files = {"profile.xml": PROFILE, "resources/navi.xml": NAVI, "pages/p 1.html": LOG_PAGE, "pages/a.html": "<h2>处理步骤</h2>do"}
    for name, text in files.items():
        at = tmp_path / "dir" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        for name, text in files.items():
            z.writestr(f"doc\\{name}" if name == "profile.xml" else f"doc/{name}", text)
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("nested.hdx", inner.getvalue())
    shown = ["entry_type", "module", "severity", "brief", "message", "cause", "action", "product_type"]
    a = sorted(map(tuple, package.read_archives(spark, [str(tmp_path)]).select(*shown).collect()))
    b = sorted(map(tuple, package.read_directory(spark, str(tmp_path / "dir")).select(*shown).collect()))
    assert a == b
    assert ("LOG", "BGP", 4, "PEER_DOWN", "Peer [Peer] is down.", "Line.\nPeer.", "", "NE40E") in a
    assert ("ALARM", "IFNET", 4, "hwIfDown", "", "", "do", "NE40E") in a


def test_archives_that_lead_out_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(package.PackageError):
        list(package.entries(out.getvalue()))
    assert package.resolve("a/b", "../../../x") == "" and package.resolve("a", "x%20y.html?q#z") == "a/x y.html"


def _fault(id_, s, module, brief, device=1, params="{}", severity=4):
    return (id_, device, f"2026-01-01 00:0{s // 60}:{s % 60:02d}", "h", "f", module, brief, severity, params)


def _logs(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, device_id bigint, t string, hostname string, source_file string, module string, brief string, severity int, parameters_json string")
    return df.withColumn("timestamp", F.col("t").cast("timestamp_ntz"))


def test_root_causes(spark):
    rows = [
        _fault(1, 0, "IFNET", "IF_DOWN", params='{"Interface":"GE1"}'), _fault(2, 0, "BFD", "BFD_SESS_DOWN", params='{"Interface":"GE1"}'), _fault(3, 1, "BGP", "PEER_BACKWARD"), _fault(4, 2, "RM", "ROUTE_DELETE"),
        _fault(5, 1, "BFD", "BFD_SESS_DOWN", device=2), _fault(6, 3, "BGP", "PEER_UP"), _fault(7, 4, "BFD", "BFD_SESS_DOWN", params='{"Interface":"GE2"}'),
    ]
    found = rca.analyse(_logs(spark, rows)).collect()
    assert [(r["root_id"], r["rule"], r["correlated_ids"], r["impact_level"]) for r in found] == [(1, "LINK_ROUTING_CASCADE", [1, 2, 3, 4], "CRITICAL")]
    # .50 + .18 + .09 + .15, and .10 less as not all name their interface
    assert found[0]["confidence"] == pytest.approx(0.82)
    assert {i["log_id"]: i["from_log_id"] for i in found[0]["impacts"]} == {2: 1, 3: 1, 4: 3}
    with pytest.raises(ValueError):
        rca.rule("loop", ("A", "X", "A", "X"))


def test_windows_that_overlap(spark):
    stamps = spark.createDataFrame([(s * 1_000_000,) for s in (0, 100, 239, 240, 500, 501, 2000)], "us bigint")
    assert [r["start_us"] // 1_000_000 for r in windows.overlapping_windows(stamps).orderBy("window").collect()] == [0, 240, 500, 2000]


def test_time_alignment_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 3)
    known = {2: 20, 3: 30, 8: 80}
    rows = spark.createDataFrame([("a", s, known.get(s)) for s in range(12)] + [("b", 0, None)], "source_file string, seq bigint, timestamp bigint")
    got = {(r["source_file"], r["seq"]): r["timestamp"] for r in windows.align_times(rows).collect()}
    assert [got["a", s] for s in range(12)] == [20, 20, 20, 30, 30, 30, 30, 30, 80, 80, 80, 80] and got["b", 0] is None


def test_root_causes_cross_weeks(spark):
    # groups of stretches are dealt by weeks from the epoch, one of which ends at this midnight
    down, lost = ("IFNET", "IF_DOWN", 3, "{}"), ("BFD", "SESS_DOWN", 4, "{}")
    at = [("2025-12-31 23:58:00", down), ("2026-01-01 00:01:00", lost), ("2026-01-01 02:00:00", down), ("2026-01-01 02:01:00", lost), ("2026-01-01 03:00:00", down), ("2026-01-01 03:10:00", lost)]
    rows = [(k, 1, t, "h", "f", *what) for k, (t, what) in enumerate(at, 1)]
    assert [(r["root_id"], r["correlated_ids"]) for r in rca.analyse(_logs(spark, rows)).collect()] == [(1, [1, 2]), (3, [3, 4])]


@pytest.mark.parametrize(("length", "overlap"), [(300, 60), (300, 0), (9000, 60), (60, 60), (10, 20)])
@pytest.mark.parametrize("fan", [2, 64])
def test_window_chains_cross_blocks(spark, monkeypatch, length, overlap, fan):
    monkeypatch.setattr(windows, "FAN", fan)
    monkeypatch.setattr(windows, "TIMES", 1 if fan == 2 else 1_000_000)
    draw, hour = random.Random(length + overlap), windows.CHAIN_S
    dense = [draw.randrange(-2 * hour, 2 * hour) for _ in range(600)]
    times = sorted({*dense, -hour, 0, hour, *(30 * hour + 7 * k for k in range(40)), 40 * hour - 1, 40 * hour})
    # an overlap as long as the window is half of it; none begins after a window that holds the last time
    find, step = bisect.bisect_left if overlap else bisect.bisect_right, length - (length // 2 if overlap >= length else overlap)
    want, k = [], 0
    while k < len(times) and (not want or want[-1] + length < times[-1]):
        want.append(times[k])
        k = max(k + 1, find(times, times[k] + step))
    stamps = spark.createDataFrame([(t * 1_000_000,) for t in times + times[:5]] + [(None,)], "us bigint")
    found = windows.overlapping_windows(stamps, length, overlap).orderBy("window").collect()
    assert [tuple(r) for r in found] == [(i, t * 1_000_000, (t + length) * 1_000_000) for i, t in enumerate(want)]
    assert windows.overlapping_windows(stamps.where("us IS NULL"), length, overlap).count() == 0


def test_large_files_are_read_in_splits(spark, tmp_path):
    want = {"a b.log": ["\ufeff0 x"] + [f"{k} " + "ab界"[: k % 4] * (k % 17) + "\r" for k in range(1, 400)], "c.log": [f"{k} 接口" for k in range(300)], "none.log": []}
    for name, lines in want.items():
        (tmp_path / name).write_bytes("".join(x + "\n" for x in lines).encode("gb18030" if name == "c.log" else "utf-8"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = raw.read_lines(spark, [str(tmp_path)], "*.log")
        assert lines.sparkSession.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        found = sorted(map(tuple, lines.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == sorted((name, k, x.strip("\r\ufeff")) for name, own in want.items() for k, x in enumerate(own))


def test_bytes_of_no_encoding_are_replaced(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"ok\n" * 30_000 + b"a\xffb\n")
    assert raw.read_lines(spark, [str(tmp_path)]).where("seq = 30000").head()["line"] == "a\ufffdb"


def test_sessions_go_on_over_midnight(spark):
    rows = [(k, 1, f"2026-01-0{1 + s // 86400} {s % 86400 // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}", "h", "f", "M", "B", 4, "{}") for k, s in enumerate([86390, 86395, 86405, 86466, 86470, 86472, 172799, 172800, 172801])]
    found = windows.correlated_clusters(_logs(spark, rows), timeline_limit=None).orderBy("start_us").collect()
    assert [r["events"] for r in found] == [3, 3, 3]


def test_matching_excludes_families_and_caps_suspects(spark):
    kb = spark.createDataFrame(
        [(1, "LOG", "WLAN", 4, "STA", "x", "", "", "", "official"), (2, "LOG", "WLAN", 4, "STA", "y", "", "", "", "official"), (3, "LOG", "AAA", 4, "ONLY", "z", "", "", "", "official")],
        "id bigint, entry_type string, module string, severity int, brief string, message string, description string, cause string, action string, source string",
    ).withColumn("parameters", F.lit(""))
    versions = spark.createDataFrame([(1, 1, 5, "CE12800", "V1"), (2, 2, 6, "AirEngine 5760", "V1"), (3, 3, 7, "NE40E", "V1")], "id bigint, knowledge_id bigint, document_id bigint, product_type string, product_version string")
    rows = spark.createDataFrame([(1, "WLAN", "STA", 4, "[WLAN_STA_INFO]a"), (2, "AAA", "ONLY", 4, "[WLAN_STA_INFO]z"), (3, "COMMENT", "STA", 4, "")], "id bigint, module string, brief string, severity int, message_body string")
    found = {r["id"]: r for r in matching.match(rows, matching.prepare(kb, versions), with_search=False).collect()}
    assert found[1]["knowledge_id"] == 2 and found[1]["match_tier"] == "EXACT" and found[1]["matched_document_id"] == 6
    assert found[2]["match_tier"] == "FAMILY_SUSPECT" and found[2]["match_confidence"] <= 0.3
    assert found[3]["match_tier"] == "UNMATCHED"


def test_tagging_twice_changes_nothing(spark, logs):
    own = logs.where("severity = 1")
    once = tags.tag(L.relations(spark, SF), own, 2)
    assert once.count() == tags.tag(once, own, 2).count()
    assert tags.untag(once, own, 2).where("tag_id = 2").join(own.select(F.col("id").alias("log_id")), "log_id").count() == 0


@pytest.mark.parametrize(("mode", "want"), [("skip", {"x.log": "skip", "y.log": "import"}), ("overwrite", {"x.log": "overwrite", "y.log": "import"}), ("rename", {"x.log": "rename", "y.log": "import"})])
def test_conflict_modes(spark, mode, want):
    new, there = spark.createDataFrame([("x.log",), ("y.log",)], "name string"), spark.createDataFrame([("[d]_x.log",)], "name string")
    assert {r["name"]: r["action"] for r in tags.file_conflicts(new, there, mode).collect()} == want


def test_reports(spark, logs, tmp_path):
    assert "<h2>Modules</h2>" in export.html_report(logs, "T <1>") and "T &lt;1&gt;" in export.html_report(logs, "T <1>")
    assert timeline.conclusion(logs, [1, 2]).startswith("1. ")
    assert "| module | rows | worst severity |" in timeline.summary_markdown(logs, "T")
    with zipfile.ZipFile(io.BytesIO(export.evidence(logs, "T"))) as z:
        assert {"report.html", "logs.csv", "metadata.json", "README.txt"} == set(z.namelist())
    stored = logs.withColumn("task_id", F.lit("t"))
    export.write_logs(stored, str(tmp_path / "t"))
    export.write_logs(stored.where("source_file LIKE '%f1.log'").limit(5), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("source_file LIKE '%f2.log'").count() == logs.where("source_file LIKE '%f2.log'").count()


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streams_agree_with_batches(spark, logs, tmp_path):
    logs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
    _run(ingest.folded(stream), "folded", "complete")
    assert spark.table("folded").agg(F.sum("n")).head()[0] == logs.where("timestamp IS NOT NULL").count()
    rows = logs.select("source_file", F.col("id").alias("seq"), micros("timestamp").alias("us"))
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    _run(ingest.align(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))), "aligned")
    batch = windows.align_times(rows.withColumnRenamed("us", "timestamp")).select("source_file", "seq", F.col("timestamp").alias("us"))
    assert sorted(map(tuple, spark.table("aligned").collect())) == sorted(map(tuple, batch.collect()))


def test_a_dense_day_is_cut_into_even_tasks(spark):
    # a thousand times a second on one day, for an hour and a half: three blocks, and answers that don't merge
    stamps = spark.range(0, 5_400_000).selectExpr("id * 1000 + 1700000000000000 AS us")
    found = windows.overlapping_windows(stamps).orderBy("window").collect()
    want = [1700000000000000 + k * 240_000_000 for k in range(23)]
    assert [r["start_us"] for r in found] == [w for k, w in enumerate(want) if not k or want[k - 1] + 300_000_000 < 1700000000000000 + 5_399_999_000]


def test_sessions_over_slots_equal_sessions_over_events(spark):
    rng = random.Random(8)
    rows = [(k, rng.randint(0, 3), rng.choice("abc"), rng.randint(0, 400) * 997_000 + rng.choice([0, 86_400_000_000])) for k in range(300)]
    df = spark.createDataFrame(rows, "id bigint, device_id bigint, module string, us bigint").withColumn("timestamp", F.timestamp_micros("us").cast("timestamp_ntz"))
    for gap in (0, 1, 3, 60):
        own = sorted((us, k, d, m.upper()) for k, d, m, us in rows if d > 0)
        groups, last = [], None
        for e in own:
            if last is None or e[0] - last > gap * 1_000_000:
                groups.append([])
            groups[-1].append(e)
            last = e[0]
        want = sorted((g[0][0], g[-1][0], len(g), len({e[2] for e in g}), ",".join(map(str, sorted({e[2] for e in g}))), ",".join(dict.fromkeys(e[3] for e in g))) for g in groups if len({e[2] for e in g}) >= 2 or len(g) >= 3)
        found = windows.correlated_clusters(df, gap_s=gap, timeline_limit=None).collect()
        assert sorted(tuple(r) for r in found) == want
