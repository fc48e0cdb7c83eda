"""Root-cause analysis in slices of time: it can be stopped at any moment and keeps what is settled by then.

A folder holds one analysis: the logs by slice (a range of windows), and for each slice that is done what is known of its
windows, with a marker that says up to which time. Slices go in order, each with the claims of those before it, so that what is there is always
a prefix of the whole answer. A limit of time interrupts the jobs under the analysis's tag; the slice at work is dropped and
every slice before it stays. Going on, in this driver or another one, begins with the first slice that isn't done.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen import store
from syslumen.operators import rca
from syslumen.operators.windows import overlapping_windows
from syslumen.session import micros

# Why an analysis ended early.
TIMEOUT, CANCELLED, EVENT_CAP = "TIMEOUT", "CANCELLED", "EVENT_CAP"
#: Windows of a slice: about a day.
SLICE = 360

_DONE = "slice bigint, until_us bigint, events bigint"


@dataclass
class Result:
    """Events so far, whether there may be more, up to which time (in microseconds) all is settled, and why it ended early."""

    events: DataFrame
    truncated: bool
    analyzed_until: int | None
    error: str | None


class Interrupted(Exception):
    """Stopped between two jobs."""


class Analysis:
    """One analysis in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, rules: list[rca.Edge] | None = None, most_nodes: int | None = rca.NODES, windows: int = SLICE):
        self.spark, self.path, self.rules, self.most_nodes, self.windows = spark, path.rstrip("/"), rca.RULES if rules is None else rules, most_nodes, windows
        self.tag, self._stop, self._why = f"analysis-{uuid.uuid4().hex}", threading.Event(), None

    def cancel(self, why: str = CANCELLED) -> None:
        """Ends the work from another thread."""
        self._why = self._why or why
        self._stop.set()
        self.spark.interruptTag(self.tag)

    def _going(self) -> None:
        if self._stop.is_set():
            raise Interrupted

    def _plan(self, logs: DataFrame) -> None:
        """Writes the logs by slice and the slices with their ends, once; the plan is there when its marker is."""
        if store.names(self.spark, f"{self.path}/planned"):
            return
        rows = rca.placed(logs, self.rules)
        within = F.array_distinct(F.transform("windows", lambda w: F.floor(w["window"] / self.windows)))
        # a log is in each slice that one of its windows is in
        rows.withColumn("slice", F.explode(within)).write.mode("overwrite").partitionBy("slice").parquet(f"{self.path}/rows")
        self._going()
        times = logs.select(micros("timestamp").alias("us")).where("us IS NOT NULL")
        last = times.agg(F.max("us").alias("last"))
        # a slice ends where its last window does, or with the last log
        ends = overlapping_windows(times, rca.WINDOW_S, rca.OVERLAP_S).groupBy(F.floor(F.col("window") / self.windows).alias("slice")).agg(F.max("end_us").alias("end"))
        ends.crossJoin(F.broadcast(last)).select("slice", F.least("end", "last").alias("until_us")).write.mode("overwrite").parquet(f"{self.path}/slices")
        self._going()
        store.put_if_absent(self.spark, f"{self.path}/planned/0.json", {"windows": self.windows})

    def _known(self, k: int) -> str:
        return f"{self.path}/known/slice={k}"

    def _settle(self, k: int, until_us: int) -> int:
        """Works one slice out; gives the number of its events."""
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("slice") == k).drop("slice")
        claims = None
        if k and store.names(self.spark, self._known(k - 1)):
            before = self.spark.read.parquet(self._known(k - 1)).select("subject", F.explode("reaches").alias("r"))
            claims = before.select("subject", F.col("r.id").alias("id"), F.col("r.window").alias("window")).where(F.floor(F.col("window") / self.windows) == k)
        scratch = f"{self.path}/scratch-{uuid.uuid4().hex}"
        try:
            known = rca.settled(rows, self.rules, self.most_nodes, claims, scratch, within=(k * self.windows, (k + 1) * self.windows))
            self._going()
            known.write.mode("overwrite").parquet(self._known(k))
        finally:
            store.drop(self.spark, scratch)
        found = self.spark.read.parquet(self._known(k)).agg(F.coalesce(F.sum(F.size("events")), F.lit(0)).alias("n")).head()["n"]
        self._going()
        store.put_if_absent(self.spark, f"{self.path}/done/{k:09d}.json", {"slice": k, "until_us": until_us, "events": found})
        return found

    def run(self, logs: DataFrame, limit_s: float | None = None, most_events: int | None = rca.EVENTS) -> Result:
        """Goes on until all is settled, the limit of time is over, somebody cancels or ``most_events`` are found.

        What was stopped stays so; another ``Analysis`` of the same folder goes on.
        """
        timer = threading.Timer(limit_s, lambda: self.cancel(TIMEOUT)) if limit_s is not None else None
        error = None
        self.spark.addTag(self.tag)
        if timer:
            timer.daemon = True
            timer.start()
        try:
            self._going()
            self._plan(logs)
            done = {r["slice"]: r["events"] for r in store.rows(self.spark, f"{self.path}/done", _DONE).collect()}
            n = sum(done.values())
            # one row a slice: a day each
            for r in self.spark.read.parquet(f"{self.path}/slices").orderBy("slice").collect():
                if most_events is not None and n >= most_events:
                    error = EVENT_CAP
                    break
                if r["slice"] not in done:
                    self._going()
                    n += self._settle(r["slice"], r["until_us"])
        except Exception:
            # an interrupted job fails; anything else is an error of its own
            if not self._stop.is_set():
                raise
            error = self._why
        finally:
            if timer:
                timer.cancel()
            self.spark.removeTag(self.tag)
        return self.result(most_events, error)

    def result(self, most_events: int | None = rca.EVENTS, error: str | None = None) -> Result:
        """What is settled so far."""
        # one row a slice
        done = store.rows(self.spark, f"{self.path}/done", _DONE).orderBy("slice").collect()
        found = self._events([r["slice"] for r in done])
        if most_events is not None:
            if error is None and sum(r["events"] for r in done) > most_events:
                error = EVENT_CAP
            found = found.orderBy("window", "root_us", "root_id").limit(most_events)
        return Result(found, error is not None, done[-1]["until_us"] if done else None, error)

    def _events(self, slices: list[int]) -> DataFrame:
        if not slices:
            return rca.events_of(self.spark.createDataFrame([], rca._WINDOW))
        return rca.events_of(self.spark.read.option("basePath", f"{self.path}/known").parquet(*(self._known(k) for k in slices)).drop("slice"))
