"""What a row costs: steps that a plan works out once, whatever their result is used for."""

from __future__ import annotations

import pytest

from syslumen.queries import load

SF = "/root/testdata/sf0.001"
QUERIES, _ = load()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["str14_event_summaries", "str12_context"])
def test_parameters_are_normalised_once_a_row(spark, name):
    assert optimized(QUERIES[name](spark, SF)).count("transform_keys(") == 1


def test_all_texts_of_a_log_at_once(spark):
    from syslumen.operators import enrich
    from syslumen.query_knowledge import knowledge
    from syslumen.sources import logview as L

    rows = enrich.with_knowledge(L.logs(spark, SF), knowledge(spark)).select("id", "event_summary", "message_text", "cause_text").collect()
    told = {r["id"]: r["event_summary"] for r in QUERIES["str14_event_summaries"](spark, SF).collect()}
    assert {r["id"]: r["event_summary"] for r in rows} == told and any(r["message_text"] for r in rows)


def test_a_times_offset_is_looked_for_once_a_row(spark):
    assert optimized(QUERIES["prs01_line_forms"](spark, SF)).count(r"([+-]\d{2}:\d{2})$") == 1


def test_lines_of_a_file_are_not_gathered_to_be_cleaned(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" not in QUERIES["prs01_line_forms"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
