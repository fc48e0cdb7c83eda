"""Session settings and small helpers that every part of the engine uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that change results or keep plans adaptive; the rest is the cluster's business.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Rows of a dimension that may be broadcast without asking Spark's statistics first, and bytes of them as text.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without a time zone, whatever the session's zone is."""
    name = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), name.cast("timestamp_ntz"))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A hint for dimensions of at most ``most`` rows and ``BROADCAST_BYTES``; looking stops one row beyond, and is a small job of its own."""
    rows, size = df.limit(most + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))).head()
    return F.broadcast(df) if rows <= most and (size or 0) <= BROADCAST_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one on a local master where none is set."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or f"file://{tempfile.mkdtemp(prefix='syslumen-')}"


def by_value(name: str) -> None:
    """Functions of module ``name`` travel to the executors inside the plan, so that these need not have this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[name])
