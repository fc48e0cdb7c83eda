"""Ordered dataflow: time alignment, gap sessions, overlapping windows, numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syslumen.session import micros, shared_dir


#: Places of a file that are sorted together.
BLOCK = 1_000_000
#: Seconds whose distinct times one task follows at least, times of a longer block at most, and blocks (of blocks) whose answers are composed in one.
CHAIN_S, TIMES, FAN = 3600, 1_000_000, 64


_ANSWER = "block bigint, upto bigint, last bigint, starts bigint"


def align_times(lines: DataFrame, file: str = "source_file", seq: str = "seq", time: str = "timestamp") -> DataFrame:
    """Rows without a time take that of the last row before in the file that has one, or the first one after it.

    Files are cut into blocks of ``BLOCK`` places, so that a very large one isn't sorted in one task; what blocks
    hand on to later ones comes from one row for each.
    """
    cut = lines.withColumn("__block", F.floor(F.col(seq) / BLOCK))
    known = F.when(F.col(time).isNotNull(), F.col(seq))
    blocks = cut.groupBy(file, "__block").agg(F.max_by(time, known).alias("__last"), F.min_by(time, known).alias("__first"))
    order = Window.partitionBy(file).orderBy("__block")
    blocks = blocks.select(
        file, "__block", F.last("__last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("__first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__first"),
    )
    within = F.last(time, ignorenulls=True).over(Window.partitionBy(file, "__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    filled = cut.withColumn("__within", within).join(blocks, [file, "__block"])
    return filled.withColumn(time, F.coalesce("__within", "__before", "__first")).select(*lines.columns)


def correlated_clusters(logs: DataFrame, gap_s: int = 60, timeline_limit: int | None = 500) -> DataFrame:
    """Sessions of events at most ``gap_s`` apart, with two devices or three events at least.

    ``start_us, end_us, events, devices, device_ids, modules`` (in the order first seen). Events of one slot as long as the gap are
    always of one session, so that they are counted first, by slot, device and module: however many events there are, what is
    put in order after that are slots, by day, and days where they meet. A module's place follows from its first event.
    """
    own = logs.where("device_id > 0 AND timestamp IS NOT NULL AND module <> 'COMMENT'").select("id", "device_id", F.upper("module").alias("module"), micros("timestamp").alias("us"))
    if timeline_limit is not None:
        own = own.orderBy("us", "id").limit(timeline_limit)
    gap = gap_s * 1_000_000
    slot = F.floor(F.col("us") / max(gap, 1)).alias("slot")
    cells = own.groupBy(slot, "device_id", "module").agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"), F.min(F.struct("us", "id")).alias("first"))
    slots = cells.groupBy("slot").agg(F.min("a").alias("a"), F.max("b").alias("b")).withColumn("day", F.floor(F.col("a") / 86_400_000_000))
    w = Window.partitionBy("day").orderBy("slot")
    slots = slots.withColumn("new", F.when(F.col("a") - F.lag("b").over(w) <= gap, 0).otherwise(1))
    slots = slots.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # where days meet, sessions may go on: that takes the first and the last session of each day, one row a day
    ends = slots.groupBy("day").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("part").alias("last"))
    line = Window.partitionBy(F.lit(0)).orderBy("day")
    ends = ends.withColumn("goes_on", F.coalesce(F.col("a") - F.lag("b").over(line) <= gap, F.lit(False)))
    chain = F.sum(F.when((F.col("last") == 1) & F.col("goes_on"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("chain", chain)
    ends = ends.withColumn("before", F.lag("chain").over(line)).select("day", "last", "goes_on", "chain", "before")
    named = slots.select("slot", "day", "part").join(ends, "day")
    key = F.when((F.col("part") == 1) & F.col("goes_on"), F.struct(F.lit(-1).cast("bigint").alias("d"), F.col("before").alias("p")))
    key = key.when(F.col("part") == F.col("last"), F.struct(F.lit(-1).cast("bigint").alias("d"), F.col("chain").alias("p"))).otherwise(F.struct(F.col("day").alias("d"), F.col("part").cast("bigint").alias("p")))
    placed = cells.join(named.select("slot", key.alias("key")), "slot")
    made = placed.groupBy("key").agg(F.min("a").alias("start_us"), F.max("b").alias("end_us"), F.sum("n").alias("events"), F.array_sort(F.collect_set("device_id")).alias("device_ids"))
    seen = placed.groupBy("key", "module").agg(F.min("first").alias("first")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "module"))).alias("seen"))
    made = made.where("size(device_ids) >= 2 OR events >= 3").join(seen, "key")
    return made.select("start_us", "end_us", "events", F.size("device_ids").alias("devices"), F.array_join(F.transform("device_ids", lambda d: d.cast("string")), ",").alias("device_ids"), F.array_join(F.transform("seen", lambda s: s["module"]), ",").alias("modules"))


def overlapping_windows(stamps: DataFrame, length_s: int = 300, overlap_s: int = 60, time: str = "us") -> DataFrame:
    """``window, start_us, end_us``: windows of ``length_s`` (end included) that begin at the first time and then at the
    first time at or after the last start plus ``length_s - overlap_s``, or, with no overlap, after the last window; none begins after one that holds the last time.

    The starts form a chain, each found from the one before. Times are cut into blocks of ``CHAIN_S`` seconds, and each
    block tells for the times where a chain can enter it how many starts that chain has there, and which is its last. These
    answers are composed, ``FAN`` blocks at a time, until one answer is for all; then each block learns from the one above where the
    chain enters it, and makes the windows of its own piece. No task sees more than ``FAN`` answers or a block's times.
    """
    import numpy as np
    import pandas as pd

    # an overlap can't be as long as a window: then it is half of it
    overlap_s = length_s // 2 if overlap_s >= length_s else max(overlap_s, 0)
    length, step = length_s * 1_000_000, (length_s - overlap_s) * 1_000_000
    # a block is a step at least, so that what finds no start in it enters the next one at its first time
    size, side = max(CHAIN_S * 1_000_000, step), "left" if overlap_s else "right"

    def answers(pdf):
        at = np.sort(pdf["us"].to_numpy())
        block, n = pdf["block"].iloc[0], len(at)
        following = np.maximum(np.searchsorted(at, at + step, side=side), np.arange(n) + 1)
        # the last start before the block is followed by a time in the block's first step, or by the first one after it
        entries = np.arange(min(n, np.searchsorted(at, origin + block * size + step, side=side) + 1))
        last, starts = entries.copy(), np.ones(len(entries), dtype="int64")
        while (on := following[last] < n).any():
            last[on] = following[last[on]]
            starts[on] += 1
        ends = np.append((np.diff(last) != 0) | (np.diff(starts) != 0), True)
        return pd.DataFrame({"block": block, "upto": at[entries[ends]], "last": at[last[ends]], "starts": starts[ends]})

    far = 1 << 62

    def told(own, since):
        """Of a block's answers, those for chains that wait since some times, and whether there is one."""
        k = np.searchsorted(own["upto"].to_numpy(), since, side=side)
        found = k < len(own)
        k = np.minimum(k, len(own) - 1)
        return found, own["last"].to_numpy()[k], own["starts"].to_numpy()[k]

    def composed(pdf):
        blocks = [own for _, own in pdf.sort_values(["block", "upto"]).groupby("block")]
        upto, last, n = (blocks[0][c].to_numpy() for c in ("upto", "last", "starts"))
        if len(blocks) > 1 and upto[-1] != far:
            # a chain that finds nothing in the first block enters the next one at its first time
            upto, last, n = np.append(upto, far), np.append(last, -far), np.append(n, 0)
        for own in blocks[1:]:
            found, then, more = told(own, np.where(n > 0, last + step, -far))
            last, n = np.where(found, then, last), n + np.where(found, more, 0)
        ends = np.append((np.diff(last) != 0) | (np.diff(n) != 0), True)
        return pd.DataFrame({"block": pdf["above"].iloc[0], "upto": upto[ends], "last": last[ends], "starts": n[ends]})

    def walk(pdf):
        out, since, n = [], pdf["since"].iloc[0], pdf["before"].iloc[0]
        for block, own in pdf.sort_values(["block", "upto"]).groupby("block"):
            found, last, starts = told(own, np.array([since]))
            if found[0]:
                out.append((block, since, n))
                since, n = last[0] + step, n + starts[0]
        return pd.DataFrame(out, columns=["block", "since", "before"])

    def follow(pdf):
        at, since = np.sort(pdf["us"].to_numpy()), pdf["since"].iloc[0]
        starts, k, start = [], int(np.searchsorted(at, since, side=side)), since - step
        # none begins after one that holds the last time
        while k < len(at) and start + length < latest:
            start = at[k]
            starts.append(start)
            k = max(k + 1, int(np.searchsorted(at, start + step, side=side)))
        before = pdf["before"].iloc[0]
        return pd.DataFrame({"window": range(before, before + len(starts)), "start_us": starts, "end_us": [s + length for s in starts]})

    times = stamps.select(F.col(time).cast("bigint").alias("us")).where("us IS NOT NULL").distinct()
    hours = times.groupBy(F.floor(F.col("us") / size)).agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"))
    ends = hours.agg(F.min("a").alias("first"), F.max("b").alias("last"), F.max("n").alias("most")).head()
    if ends["first"] is None:
        return times.select(F.lit(0).alias("window"), F.col("us").alias("start_us"), F.col("us").alias("end_us"))
    origin, latest = ends["first"], ends["last"]
    # blocks of sparse times are longer: any of this length meets one hour more than it has
    size *= max(1, TIMES // ends["most"] - 1)
    times = times.withColumn("block", F.floor((F.col("us") - origin) / size))
    above = lambda df: df.withColumn("above", F.floor(F.col("block") / FAN))
    blocks, spark = (latest - origin) // size + 1, times.sparkSession
    one, base = blocks <= FAN, f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"

    def kept(df, name):
        # answers of several levels are looked at twice, on the way up and down
        if one:
            return df
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    levels = [kept(times.groupBy("block").applyInPandas(answers, _ANSWER), "0")]
    while blocks > FAN:
        levels.append(kept(above(levels[-1]).groupBy("above").applyInPandas(composed, _ANSWER), str(len(levels))))
        blocks = -(-blocks // FAN)
    entered = spark.createDataFrame([(0, -far, 0)], "above bigint, since bigint, before bigint")
    for k, level in enumerate(reversed(levels)):
        entered = above(level).join(entered, "above").groupBy("above").applyInPandas(walk, "block bigint, since bigint, before bigint")
        entered = kept(entered.withColumnRenamed("block", "above"), f"entered-{k}")
    return times.join(entered.withColumnRenamed("above", "block"), "block").groupBy("block").applyInPandas(follow, "window int, start_us bigint, end_us bigint")


def newest_per_key(df: DataFrame, key: list[str], recency: list[str], keep: int = 1) -> DataFrame:
    """The ``keep`` latest rows of each key."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in recency))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__r")


from syslumen.session import by_value  # noqa: E402

by_value(__name__)
