"""Matching where many logs share one signature: tasks share their bodies, and answers don't change."""

from __future__ import annotations

import os

import duckdb
import pytest

from syslumen.operators import matching
from syslumen.queries import load
from syslumen.query_knowledge import prepared

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = load()
LOGS = 20_000


@pytest.fixture
def dealt(spark, monkeypatch):
    monkeypatch.setattr(matching, "PART", 100, raising=False)
    # joins that Spark makes broadcasts of on its own, for tables as small as these or if one is ready first, would hide what a task reads
    own = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    keep = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in keep.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffle_reads(spark, run) -> dict[int, int]:
    """The most rows that a task of a stage reads from shuffles, of the stages that ``run`` adds."""
    context = spark.sparkContext._jsc.sc()
    store = context.statusStore()

    def stages():
        context.listenerBus().waitUntilEmpty(60_000)
        found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return [found.apply(i) for i in range(found.size())]

    before = {s.stageId() for s in stages()}
    run()
    most = {}
    for s in stages():
        tasks = store.taskList(s.stageId(), s.attemptId(), 100_000)
        if s.stageId() not in before:
            most[s.stageId()] = max((tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()) if tasks.apply(i).taskMetrics().isDefined()), default=0)
    return most


@pytest.mark.parametrize("bound", [False, True])
def test_no_task_reads_a_whole_signature(dealt, bound):
    logs = dealt.range(LOGS).selectExpr("id", "CASE WHEN id % 50 = 7 THEN 'SHELL' ELSE 'IFNET' END AS module", "CASE WHEN id % 50 = 7 THEN 'X' ELSE 'IF_DOWN' END AS brief", "3 AS severity", "'Interface GE' || id || ' reported click. (User=1, Code=2)' AS message_body")
    overrides = dealt.createDataFrame([("ifnet", "if_down", 2, True)], "module string, brief string, knowledge_id bigint, enabled boolean") if bound else None
    found = []
    reads = shuffle_reads(dealt, lambda: found.extend(matching.match(logs, prepared(dealt), overrides, with_search=False).groupBy("knowledge_id", "match_tier").count().collect()))
    rest = LOGS // 50
    assert sorted(tuple(r) for r in found) == [(0, "UNMATCHED", rest), (2, "LOCAL_MAPPING", LOGS - rest) if bound else (1, "EXACT", LOGS - rest)]
    # the last joins read two tables
    assert max(reads.values()) < LOGS / 2


@pytest.mark.parametrize("name", ["mat01_override", "mat_all_tiers", "mat03_tier_counts"])
def test_answers_of_dealt_bodies(dealt, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{os.path.join(SF, 'events.parquet')}'")
    want = c.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r[k] for k in columns) for r in QUERIES[name](dealt, SF).collect()) == sorted(want.fetchall())
