"""Published indexes and jobs: what fails changes nothing, and one run of a task is open at a time."""

from __future__ import annotations

import pytest

from syslumen.operators import indexing, jobs


def test_a_failed_rebuild_keeps_the_index_in_use(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "one two"), (2, "two three"), (3, None)], "id bigint, text string")
    with pytest.raises(ValueError):
        indexing.current(spark, root)
    assert indexing.is_stale(spark, root)
    first = indexing.rebuild(root, docs, "id", "text")
    assert not indexing.is_stale(spark, root) and indexing.current(spark, root).select("doc").distinct().count() == 2
    monkeypatch.setattr(indexing.search, "index", lambda d, key, *fields, own=indexing.search.index: own(d.where("id = 1"), key, *fields))
    with pytest.raises(ValueError):
        indexing.rebuild(root, docs, "id", "text")
    assert {r["doc"] for r in indexing.current(spark, root).collect()} == {1, 2}
    second = indexing.rebuild(root, docs.where("id = 1"), "id", "text", mapping=2)
    assert indexing.is_stale(spark, root) and indexing.current(spark, root).count() == 0
    assert indexing.roll_back(spark, root) == first != second and indexing.current(spark, root).count() == 4


def test_one_run_of_a_task_at_a_time(spark, tmp_path):
    own = jobs.Jobs(spark, str(tmp_path / "jobs"))
    seen = []

    def work():
        # asked for again while it runs
        seen.append(own.run("a", lambda: seen.append("twice")))

    assert own.run("a", work) == jobs.COMPLETED and seen == [jobs.RUNNING]
    with pytest.raises(ZeroDivisionError):
        own.run("a", lambda: 1 / 0)
    now = jobs.states(own.changes()).head()
    assert (now["run"], now["state"], now["error"]) == (2, jobs.FAILED, "division by zero")

    def late():
        raise TimeoutError("too long")

    assert own.run("b", late) == jobs.TIMEOUT
    own._mark("c", 1, jobs.RUNNING)
    assert own.run("c", lambda: seen.append("never")) == jobs.RUNNING
    own.recover()
    assert {r["task_id"]: r["state"] for r in jobs.states(own.changes()).collect()} == {"a": jobs.FAILED, "b": jobs.TIMEOUT, "c": jobs.FAILED}
    assert own.run("c", lambda: None) == jobs.COMPLETED and "never" not in seen
