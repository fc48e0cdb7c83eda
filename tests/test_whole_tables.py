"""Queries whose chains and searches run over every row."""

from __future__ import annotations

import bisect

import pytest

from syslumen.queries import load
from syslumen.session import micros
from syslumen.sources import logview as L

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = load()


@pytest.mark.parametrize(("name", "step", "end"), [("win03_overlapping_windows", 240, bisect.bisect_left), ("win04_tumbling_windows", 300, bisect.bisect_right)])
def test_windows_of_all_logs(spark, name, step, end):
    logs = L.logs(spark, SF)
    assert logs.where("id > 2000").count()
    times = sorted({r[0] for r in logs.select(micros("timestamp")).collect()} - {None})
    starts, k = [], 0
    # none begins after one that holds the last time
    while k < len(times) and (not starts or starts[-1] + 300_000_000 < times[-1]):
        starts.append(times[k])
        k = end(times, times[k] + step * 1_000_000)
    found = sorted((r["window"], r["start_us"], r["end_us"]) for r in QUERIES[name](spark, SF).collect())
    assert found == [(i, s, s + 300_000_000) for i, s in enumerate(starts)]


@pytest.mark.parametrize("name", ["fts03_bm25", "join14_search_candidates"])
def test_every_item_is_a_query(spark, name):
    items = {r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").collect()}
    assert {r["query"] for r in QUERIES[name](spark, SF).collect()} == items
