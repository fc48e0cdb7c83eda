"""Exports of more rows than one page or one text holds."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from syslumen.queries import load
from syslumen.sinks import export
from syslumen.sources import logview as L

QUERIES, _ = load()
ROWS = 105_000


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Events whose logs are all of severity 1, but for comments and lines that no parser took."""
    base = tmp_path_factory.mktemp("many")
    rows = spark.range(ROWS).select((F.col("id") * 8).alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 5000).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.where("event_id % 50 <> 7 AND event_id % 97 <> 5").write.parquet(f"{base}/events.parquet")
    return str(base)


def test_every_row_is_exported_in_log_order(spark, many):
    found = [(r["us"] if r["us"] is not None else -1, r["id"]) for r in QUERIES["lim04_export_rows"](spark, many).collect()]
    assert len(found) == L.logs(spark, many).where("severity <= 2").count() > 100_000
    assert found == sorted(found)


def test_the_archive_holds_every_row(spark, many):
    logs = L.logs(spark, many)
    with zipfile.ZipFile(io.BytesIO(export.evidence(logs, "T"))) as z:
        assert {"report.html", "logs.csv", "metadata.json", "README.txt"} == set(z.namelist())
        lines = z.read("logs.csv").decode("utf-8-sig").split("\r\n")
    assert len(lines) == logs.count() + 2 and lines[0].startswith("id,timestamp") and lines[-1] == ""
