"""Analysis jobs as a table of state changes: one run of a task at a time, few runs at once, and what a lost driver leaves behind.

``task_id, run, state, at`` rows are only ever added; a task's state is its newest row. A queued or running task isn't
queued again. Each change is a file of its own whose name holds task, run and step, so that of two drivers that want the same
run only one can create it. A run renews a lease while it works; one that no longer does was lost with its driver, and is failed, so
that its task can be asked for anew.
"""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syslumen import store

# The states of an analysis.
QUEUED, RUNNING, COMPLETED, TIMEOUT, FAILED = "QUEUED", "RUNNING", "COMPLETED", "TIMEOUT", "FAILED"
OPEN = (QUEUED, RUNNING)
#: The step of a run that a state is: whoever ends a run first has ended it.
_STEP = {QUEUED: 0, RUNNING: 1, COMPLETED: 2, TIMEOUT: 2, FAILED: 2}

_CHANGE = "task_id string, run bigint, state string, at timestamp, error string"
_FILED = "task_id string, run bigint, state string, us bigint, error string"


def states(changes: DataFrame) -> DataFrame:
    """Each task's newest change; of changes at one time, the one further on."""
    place = F.array_position(F.array(*(F.lit(s) for s in (QUEUED, RUNNING, COMPLETED, TIMEOUT, FAILED))), F.col("state"))
    w = Window.partitionBy("task_id").orderBy(F.desc("run"), F.desc("at"), place.desc())
    return changes.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def claimable(asked: DataFrame, changes: DataFrame) -> DataFrame:
    """Of the ``task_id`` asked for, each once, those without an open run, and the number of their next ``run``."""
    now = states(changes).select("task_id", "run", "state")
    left = asked.select("task_id").where("task_id IS NOT NULL").distinct().join(now, "task_id", "left")
    return left.where(F.col("state").isNull() | ~F.col("state").isin(*OPEN)).select("task_id", (F.coalesce("run", F.lit(0)) + 1).cast("bigint").alias("run"))


def recovered(changes: DataFrame) -> DataFrame:
    """The changes that fail all open runs; for a start when no driver of before is left."""
    dangling = states(changes).where(F.col("state").isin(*OPEN))
    return dangling.select("task_id", "run", F.lit(FAILED).alias("state"), F.col("at"), F.lit("the run was interrupted").alias("error"))


class Jobs:
    """The changes under a path, and runs of tasks recorded there.

    ``most`` runs work at once, over all drivers that share the path; others wait in their queue. ``lease_s`` is how long a run that isn't
    heard of counts as alive. Clocks of drivers may differ by less than that.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 2, lease_s: float = 60.0, pool: str = "analyses"):
        self.spark, self.path, self.most, self.lease_s, self.pool = spark, path.rstrip("/"), most, lease_s, pool

    def changes(self) -> DataFrame:
        found = store.rows(self.spark, f"{self.path}/changes", _FILED)
        return found.select("task_id", "run", "state", F.timestamp_micros("us").alias("at"), "error")

    def _key(self, task_id: str) -> str:
        return hashlib.sha256(task_id.encode()).hexdigest()

    def _steps(self, task_id: str) -> dict[int, int]:
        """The last step of each run of a task, told from names alone."""
        key, found = self._key(task_id), {}
        for name, _ in store.names(self.spark, f"{self.path}/changes"):
            if name.startswith(key) and name.endswith(".json"):
                run, step = map(int, name.removesuffix(".json").split("-")[1:])
                found[run] = max(step, found.get(run, 0))
        return found

    def _mark(self, task_id: str, run: int, state: str, error: str | None = None) -> bool:
        """Records a change unless that step of the run was recorded before."""
        row = {"task_id": task_id, "run": run, "state": state, "us": time.time_ns() // 1000, "error": error}
        return store.put_if_absent(self.spark, f"{self.path}/changes/{self._key(task_id)}-{run}-{_STEP[state]}.json", row)

    def state(self, task_id: str) -> str | None:
        found = states(self.changes().where(F.col("task_id") == task_id)).head()
        return found["state"] if found else None

    def claim(self, task_id: str) -> int | None:
        """The number of a new run, which is this caller's alone; None if a run of the task is open."""
        steps = self._steps(task_id)
        if any(step < 2 for step in steps.values()):
            return None
        run = max(steps, default=0) + 1
        return run if self._mark(task_id, run, QUEUED) else None

    def recover(self, lost: bool = False) -> int:
        """Fails all open runs, for a start when no driver of before is left (``lost``: those whose lease ran out); gives their number."""
        heard = {name.removesuffix(".lease"): ms for name, ms in store.names(self.spark, f"{self.path}/leases") if name.endswith(".lease")}
        now, n = time.time() * 1000, 0
        # open runs: as many as there are tasks at work, not as many as ever were
        for r in states(self.changes()).where(F.col("state").isin(*OPEN)).collect():
            last = heard.get(f"{self._key(r['task_id'])}-{r['run']}", r["at"].timestamp() * 1000)
            if not lost or now - last > self.lease_s * 1000:
                n += self._mark(r["task_id"], r["run"], FAILED, "the run was interrupted")
        return n

    def _slot(self, stop: threading.Event) -> str:
        """Waits for one of the places of runs at work; a place whose holder isn't heard of is freed."""
        while True:
            held = dict(store.names(self.spark, f"{self.path}/slots"))
            for k in range(self.most):
                name = f"{k}.lease"
                if name in held and time.time() * 1000 - held[name] > self.lease_s * 1000:
                    store.drop(self.spark, f"{self.path}/slots/{name}")
                    del held[name]
                if name not in held and store.put_if_absent(self.spark, f"{self.path}/slots/{name}", {}):
                    return f"{self.path}/slots/{name}"
            if stop.wait(min(1.0, self.lease_s / 10)):
                raise TimeoutError("stopped while it waited for a place")

    def run(self, task_id: str, work: Callable[[], object]) -> str:
        """Runs ``work`` unless a run of the task is open; gives the task's state afterwards.

        Jobs of the run go to their own scheduler pool, so that with the FAIR scheduler analyses don't hold up queries.
        """
        run = self.claim(task_id)
        if run is None:
            return self.state(task_id)
        lease, done, places = f"{self.path}/leases/{self._key(task_id)}-{run}.lease", threading.Event(), [f"{self.path}/leases/{self._key(task_id)}-{run}.lease"]

        def renew() -> None:
            while True:
                for place in list(places):
                    store.replace(self.spark, place, {})
                if done.wait(self.lease_s / 4):
                    return

        store.replace(self.spark, lease, {})
        renewing = threading.Thread(target=renew, daemon=True)
        renewing.start()
        before = self.spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        state, error = FAILED, "the run was stopped"
        try:
            places.append(self._slot(done))
            self._mark(task_id, run, RUNNING)
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", self.pool)
            work()
            state, error = COMPLETED, None
        except TimeoutError as e:
            state, error = TIMEOUT, str(e)
        except Exception as e:
            state, error = FAILED, str(e)
            raise
        finally:
            done.set()
            renewing.join()
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)
            for place in places:
                store.drop(self.spark, place)
            ended = self._mark(task_id, run, state, error)
        # a run that was failed while it worked stays so
        return state if ended else self.state(task_id)


def progress(spark: SparkSession, group: str | None = None) -> DataFrame:
    """``job_id, stage_id, tasks, done, failed, percent`` of the stages of a job group, or of all that run now, as the status tracker tells them."""
    tracker, rows = spark.sparkContext.statusTracker(), []
    for job in tracker.getJobIdsForGroup(group) if group else tracker.getActiveJobsIds():
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            own = tracker.getStageInfo(stage)
            if own:
                rows.append((job, stage, own.numTasks, own.numCompletedTasks, own.numFailedTasks, 100.0 * own.numCompletedTasks / max(own.numTasks, 1)))
    return spark.createDataFrame(rows, "job_id int, stage_id int, tasks int, done int, failed int, percent double")
