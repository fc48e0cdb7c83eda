"""Queries of what keeps the engine going: published indexes, jobs, keys, pages with their totals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.functions import scalar as S
from syslumen.operators import indexing, jobs, matching
from syslumen.plans import filters as P
from syslumen.queries import query
from syslumen.query_filters import WITH
from syslumen.query_knowledge import _TOKENS
from syslumen.session import micros, read, shared_dir
from syslumen.sources import logview as L

_POSTINGS = f"SELECT item_id AS doc, token, count(*) AS tf FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL"


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


@query("fts06_rebuilt_index", _POSTINGS)
def fts06(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, root = read(spark, sf_dir, "benchmark"), _root(spark)
    indexing.rebuild(root, items.withColumn("text", F.lit("an older text")), "item_id", "text")
    indexing.rebuild(root, items, "item_id", "text")
    return indexing.current(spark, root).select("doc", "token", "tf")


@query("fts06_rolled_back_index", _POSTINGS)
def fts06_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, root = read(spark, sf_dir, "benchmark"), _root(spark)
    indexing.rebuild(root, items, "item_id", "text")
    indexing.rebuild(root, items.withColumn("text", F.lit("a text that was a mistake")), "item_id", "text")
    indexing.roll_back(spark, root)
    return indexing.current(spark, root).select("doc", "token", "tf")


def _deltas(spark: SparkSession, items: DataFrame) -> str:
    """An index of items by way of older texts, additions and deletions; those of every seventh item are gone in the end."""
    root = _root(spark)
    indexing.rebuild(root, items.withColumn("text", F.when(F.col("item_id") % 3 == 0, F.lit("an older text")).otherwise(F.col("text"))).where("item_id % 5 <> 0"), "item_id", "text")
    indexing.delete(root, items.where("item_id % 7 = 0 OR item_id % 11 = 0").select("item_id"))
    indexing.add(root, items.where("item_id % 7 <> 0 AND (item_id % 3 = 0 OR item_id % 5 = 0 OR item_id % 11 = 0)"), "item_id", "text")
    return root


_LEFT = _POSTINGS.replace("FROM benchmark", "FROM benchmark WHERE item_id % 7 <> 0")


@query("fts05_additions_and_deletions", _LEFT)
def fts05_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.current(spark, _deltas(spark, read(spark, sf_dir, "benchmark"))).select("doc", "token", "tf")


@query("fts05_compacted", _LEFT)
def fts05_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _deltas(spark, read(spark, sf_dir, "benchmark"))
    indexing.compact(spark, root)
    return indexing.current(spark, root).select("doc", "token", "tf")


@query("fts07_mapping_versions", "SELECT FALSE AS stale_as_built, TRUE AS stale_for_the_next, count(*) AS documents, CAST(0 AS BIGINT) AS of_other_versions FROM benchmark WHERE regexp_matches(lower(text), '[a-z0-9]')")
def fts07(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, root = read(spark, sf_dir, "benchmark"), _root(spark)
    indexing.rebuild(root, items, "item_id", "text", mapping=3)
    other = indexing.current(spark, root, mapping=4).agg(F.count("*").alias("of_other_versions"))
    own = indexing.current(spark, root, mapping=3).agg(F.count_distinct("doc").alias("documents"))
    marks = own.select(F.lit(indexing.is_stale(spark, root, 3)).alias("stale_as_built"), F.lit(indexing.is_stale(spark, root, 4)).alias("stale_for_the_next"), "documents")
    return marks.crossJoin(other)


#: Events as changes of jobs: a user is a task, the rank of an event its run.
_CHANGES = {"click": jobs.QUEUED, "view": jobs.RUNNING, "purchase": jobs.COMPLETED, "signup": jobs.FAILED, "error": jobs.TIMEOUT}
_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CHANGES.items()) + " ELSE 'QUEUED' END"
_NEWEST = f"WITH s AS (SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS run, {_STATE} AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").cast("bigint").alias("run"), F.expr(_STATE).alias("state"), F.col("ts").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("error"))


@query("rca13_job_states", f"{_NEWEST} SELECT task_id, CAST(run AS BIGINT) AS run, state FROM s WHERE r = 1")
def rca13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.states(_changes(spark, sf_dir)).select("task_id", "run", "state")


@query("rca13_claimable_tasks", f"{_NEWEST} SELECT task_id, CAST(run + 1 AS BIGINT) AS run FROM s WHERE r = 1 AND state NOT IN ('QUEUED', 'RUNNING')")
def rca13_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir)
    return jobs.claimable(changes, changes)


@query("rca13_recovered_runs", f"{_NEWEST} SELECT task_id, CAST(run AS BIGINT) AS run, 'FAILED' AS state FROM s WHERE r = 1 AND state IN ('QUEUED', 'RUNNING')")
def rca13_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recovered(_changes(spark, sf_dir)).select("task_id", "run", "state")


@query("snk09_progress")
def snk09(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = f"progress-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "counts modules")
    try:
        L.logs(spark, sf_dir).groupBy("module").count().collect()
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    return jobs.progress(spark, group).select("tasks", "done", "failed", "percent")


_FIELD = "strlen(trim({0})) || ':' || trim({0})"


@query("hsh02_five_fields", f"{WITH} SELECT id, sha256({' || '.join(_FIELD.format(c) for c in ("'LOG'", 'module', 'brief', 'slot_info', 'source_file'))}) AS h FROM logs")
def hsh02(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir)
    return own.select("id", S.stable_key(F.lit("LOG"), F.col("module"), F.col("brief"), F.col("slot_info"), F.col("source_file")).alias("h"))


@query("hsh04_cached_signatures", f"{WITH} SELECT id, min(id) OVER (PARTITION BY upper(trim(module)), upper(trim(brief)), severity, message_body) AS first_id FROM logs WHERE upper(trim(module)) NOT IN ('UNKNOWN', 'COMMENT') AND upper(trim(brief)) <> 'UNPARSED'")
def hsh04(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = matching.signatures(L.logs(spark, sf_dir)).select("id", matching.cache_key().alias("key"))
    return own.join(own.groupBy("key").agg(F.min("id").alias("first_id")), "key").select("id", "first_id")


@query("mat15_signatures", f"{WITH} SELECT upper(trim(module)) AS module, upper(trim(brief)) AS brief, count(*) AS logs, count(DISTINCT message_body) AS bodies FROM logs WHERE upper(trim(module)) NOT IN ('UNKNOWN', 'COMMENT') AND upper(trim(brief)) <> 'UNPARSED' GROUP BY 1, 2")
def mat15(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = matching.signatures(L.logs(spark, sf_dir))
    return own.groupBy(F.col("module_u").alias("module"), F.col("brief_u").alias("brief")).agg(F.count("*").alias("logs"), F.count_distinct("message_body").alias("bodies"))


@query("lim05_page_with_total", f"{WITH}, f AS (SELECT * FROM logs WHERE upper(module) <> 'COMMENT') SELECT id, module, epoch_us(\"timestamp\") AS us, (SELECT count(*) FROM f) AS total FROM f ORDER BY \"timestamp\" ASC NULLS FIRST, id LIMIT 100")
def lim05(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir).where(F.upper("module") != "COMMENT")
    return P.page_with_total(own, size=100).select("id", "module", micros("timestamp").alias("us"), "total")
