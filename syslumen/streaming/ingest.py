"""Streams: the batch parser on arriving lines, folded repeats and gap sessions with watermarks, time alignment with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from syslumen.session import by_value

by_value(__name__)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that arrive in a folder: ``source_file, line``."""
    return spark.readStream.text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"), F.col("value").alias("line"))


def folded(records: DataFrame, window_s: int = 300, late: str = "10 minutes") -> DataFrame:
    """Repeats of events on hosts by tumbling windows; rows later than ``late`` are left out."""
    stamped = records.withColumn("at", F.col("timestamp").cast("timestamp")).withWatermark("at", late)
    made = stamped.groupBy(F.window("at", f"{window_s} seconds").alias("w"), F.upper("module").alias("module"), "brief", "hostname")
    return made.agg(F.count("*").alias("n"), F.min("severity").alias("severity")).select(F.col("w.start").alias("start"), "module", "brief", "hostname", "n", "severity")


def sessions(records: DataFrame, gap_s: int = 60, late: str = "10 minutes") -> DataFrame:
    """Sessions of each device with gaps of at most ``gap_s``."""
    stamped = records.withColumn("at", F.col("timestamp").cast("timestamp")).withWatermark("at", late)
    made = stamped.groupBy(F.session_window("at", f"{gap_s} seconds").alias("s"), "device_id").agg(F.count("*").alias("n"))
    return made.select("device_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def align(records: DataFrame, held: int = 50_000) -> DataFrame:
    """``source_file, seq, us`` with missing times taken from the row before; rows at a file's start wait for the first time.

    The state of a file is its last time and the rows that wait, at most ``held``; beyond that they go without.
    """

    def fill(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, us in zip(rows["seq"], rows["us"], strict=True):
            if pd.notna(us):
                last = int(us)
                out += [(key[0], s, last) for s in waiting]
                waiting = []
            if last is None:
                waiting = [*waiting, int(seq)]
                if len(waiting) > held:
                    out += [(key[0], s, None) for s in waiting]
                    waiting = []
            else:
                out.append((key[0], int(seq), last))
        state.update((last, waiting))
        yield pd.DataFrame(out, columns=["source_file", "seq", "us"])

    own = records.select("source_file", "seq", "us")
    return own.groupBy("source_file").applyInPandasWithState(fill, "source_file string, seq bigint, us bigint", "last bigint, waiting array<bigint>", "append", GroupStateTimeout.NoTimeout)
