"""Cases (tasks), presets and knowledge that users change."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.functions import scalar as S
from syslumen.operators.tags import upsert
from syslumen.plans.filters import FilterError, escaped

# States, columns that lists of cases are searched in and sorted by.
TASK_STATES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
CASE_STATES = ("open", "investigating", "resolved", "closed")
SEARCHED = ("task_id", "task_name", "description", "case_number", "owner", "case_tags", "hostnames", "top_modules")
SORTS = ("start_time", "end_time", "task_name", "log_count", "status")


def states(values: list[str], known: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Known states among the values, each once in the known form, and those that aren't known."""
    by = {k.lower(): k for k in known}
    own = [v.strip() for v in values if v.strip()]
    return list(dict.fromkeys(by[v.lower()] for v in own if v.lower() in by)), [v for v in own if v.lower() not in by]


def query_cases(tasks: DataFrame, digests: DataFrame, keyword: str = "", status: list[str] | None = None, case_status: list[str] | None = None, start: Any = None, end: Any = None, sort: str = "start_time", direction: str = "desc", page: int = 1, size: int = 20) -> DataFrame:
    """Cases with their digests (which may be missing), filtered, sorted and paged; equal ones by descending id."""
    if sort not in SORTS:
        raise FilterError(f"no order by {sort!r}")
    out = tasks.join(digests.select("task_id", "hostnames", "top_modules"), "task_id", "left")
    if keyword.strip():
        test = F.lit(False)
        for c in SEARCHED:
            test = test | F.coalesce(F.col(c), F.lit("")).ilike(f"%{escaped(keyword.strip())}%")
        out = out.where(test)
    for column, values, known in (("status", status, TASK_STATES), ("case_status", case_status, CASE_STATES)):
        if values:
            good, bad = states(values, known)
            if bad:
                raise FilterError(f"unknown {column}: {', '.join(bad)}")
            out = out.where(F.col(column).isin(*good))
    if start is not None:
        out = out.where(F.col("start_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("start_time") <= F.lit(end).cast("timestamp_ntz"))
    first = F.desc(sort) if direction.lower() == "desc" else F.asc(sort)
    return out.orderBy(first, F.desc("task_id")).offset((max(page, 1) - 1) * size).limit(size)


def update_case(tasks: DataFrame, task_id: str, **fields: Any) -> DataFrame:
    """``tasks`` with those fields of one case set that are given; tags are cut and each kept once."""
    own = {k: v for k, v in fields.items() if v is not None}
    if "case_status" in own and states([own["case_status"]], CASE_STATES)[1]:
        raise FilterError(f"unknown case_status {own['case_status']!r}")
    value = {k: F.array_join(S.case_tags(F.lit(v)), ",") if k == "case_tags" else F.lit(v) for k, v in own.items()}
    return tasks.withColumns({k: F.when(F.col("task_id") == task_id, v.cast(tasks.schema[k].dataType)).otherwise(F.col(k)) for k, v in value.items()})


def save_preset(presets: DataFrame, name: str, request: dict[str, Any]) -> DataFrame:
    """Presets (``name, config``) with one more, or one replaced; paging isn't stored."""
    kept = {k: v for k, v in request.items() if k not in ("page", "page_size", "after_id")}
    row = presets.sparkSession.createDataFrame([(name, json.dumps(kept, ensure_ascii=False, sort_keys=True))], "name string, config string")
    return upsert(presets, row, ["name"])


# ---- knowledge of one's own

# The columns of local knowledge as CSV.
LOCAL_COLUMNS = ("module", "brief", "product", "version", "severity", "entry_type", "message", "description", "cause", "action", "impact", "reference")


def read_local_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of local knowledge, and those that can't be used with the reason. A header line may be there; short rows are filled with nothing."""
    schema = ", ".join(f"{c} string" for c in LOCAL_COLUMNS) + ", _corrupt string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").option("escape", '"').csv(path)
    return local_rows(rows.drop("_corrupt"))


def local_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows of local knowledge with defaults filled in (severity 4, LOG, general product), and the others with a reason."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    own = rows.withColumns({c: text(c) for c in LOCAL_COLUMNS}).where(~((F.lower("module") == "module") & (F.lower("brief") == "brief")))
    own = own.withColumn("module", F.regexp_replace("module", "^﻿", "")).where(~((F.lower("module") == "module") & (F.lower("brief") == "brief")))
    severity = F.col("severity").try_cast("int")
    bad = F.when((F.col("module") == "") | (F.col("brief") == ""), "module and brief are needed").when((F.col("severity") != "") & (severity.isNull() | ~severity.between(0, 8)), "severity is 0 to 8").when(~F.upper("entry_type").isin("", "LOG", "ALARM"), "entry_type is LOG or ALARM")
    own = own.withColumn("error", bad)
    made = own.where(F.col("error").isNull()).select(
        F.upper("module").alias("module"), "brief", F.when(F.col("product") == "", "通用").otherwise(F.col("product")).alias("product"), "version",
        F.when(F.coalesce(severity, F.lit(0)) == 0, 4).otherwise(severity).alias("severity"), F.when(F.col("entry_type") == "", "LOG").otherwise(F.upper("entry_type")).alias("entry_type"),
        "message", "description", "cause", "action", "impact", "reference", S.local_hash(F.col("module"), F.col("brief")).alias("content_hash"), F.lit("local").alias("source"),
    )
    return made, own.where(F.col("error").isNotNull()).select("module", "brief", "error")


def local_changes(known: DataFrame, rows: DataFrame) -> DataFrame:
    """``created`` and ``updated``: how many rows (the last of each module and brief) are new and how many replace one."""
    keys = rows.select(F.upper("module").alias("m"), F.upper("brief").alias("b")).distinct()
    there = known.select(F.upper("module").alias("m"), F.upper("brief").alias("b")).distinct().withColumn("there", F.lit(1))
    return keys.join(there, ["m", "b"], "left").agg(F.count(F.when(F.col("there").isNull(), 1)).alias("created"), F.count("there").alias("updated"))


def local_csv(known: DataFrame) -> DataFrame:
    """Local knowledge as CSV lines, safe to open in a spreadsheet."""
    return known.select(F.concat_ws(",", *(S.csv_safe(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in LOCAL_COLUMNS)).alias("line"))


def set_override(overrides: DataFrame, knowledge: DataFrame, module: str, brief: str, knowledge_id: int, enabled: bool = True) -> DataFrame:
    """Overrides with one set; it must point at an entry that isn't local."""
    target = knowledge.where(F.col("id") == knowledge_id).select("source").limit(1).collect()
    if not target or target[0]["source"] == "local":
        raise FilterError("an override points at an official entry")
    row = overrides.sparkSession.createDataFrame([(module.upper(), brief.upper(), knowledge_id, enabled)], "module string, brief string, knowledge_id bigint, enabled boolean")
    return upsert(overrides, row, ["module", "brief"])


def import_document(knowledge: DataFrame, mappings: DataFrame, leaves: DataFrame, document_id: int) -> tuple[DataFrame, DataFrame]:
    """Entries of a document that aren't known by their hash, and mappings with the document's in place of its old ones."""
    new = leaves.dropDuplicates(["content_hash"]).join(knowledge.select("content_hash"), "content_hash", "left_anti")
    rows = leaves.select("content_hash", F.lit(document_id).cast("bigint").alias("document_id"), "topic_id", "product_type", "product_version").distinct()
    return new, mappings.where(F.col("document_id") != document_id).unionByName(rows, allowMissingColumns=True)
