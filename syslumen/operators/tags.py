"""Tags, devices, presets and other small tables that change: each change is a new table made from the old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syslumen.session import broadcast_if_small


def usage(tags: DataFrame, relations: DataFrame) -> DataFrame:
    return tags.join(relations, "tag_id", "left").groupBy("tag_id", "name").agg(F.count("log_id").alias("logs"))


def tags_of_logs(logs: DataFrame, tags: DataFrame, relations: DataFrame) -> DataFrame:
    """``logs`` with ``tags``, an array ordered by tag id (empty without any); rows aren't multiplied."""
    ids = logs.select(F.col("id").alias("log_id"))
    own = relations.join(ids, "log_id", "left_semi").join(broadcast_if_small(tags), "tag_id")
    listed = own.groupBy(F.col("log_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("tag_id", "name", "color"))).alias("tags"))
    return logs.join(listed, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<tag_id:bigint,name:string,color:string>>")))


def tag(relations: DataFrame, logs: DataFrame, tag_id: int) -> DataFrame:
    """The relations with ``tag_id`` on all of ``logs``; what is there already stays once."""
    return relations.union(logs.select(F.lit(tag_id).cast("bigint").alias("tag_id"), F.col("id").alias("log_id"))).dropDuplicates(["tag_id", "log_id"])


def untag(relations: DataFrame, logs: DataFrame, tag_id: int) -> DataFrame:
    gone = logs.select(F.lit(tag_id).cast("bigint").alias("tag_id"), F.col("id").alias("log_id"))
    return relations.join(gone, ["tag_id", "log_id"], "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with the same key, or added."""
    return table.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes.select(*table.columns))


def delete(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(*key).distinct(), key, "left_anti")


def delete_file(logs: DataFrame, relations: DataFrame, source_file: str) -> tuple[DataFrame, DataFrame]:
    """Logs without those of a file, and relations without what hung on them."""
    left = logs.where(~F.col("source_file").eqNullSafe(F.lit(source_file)))
    return left, relations.join(left.select(F.col("id").alias("log_id")), "log_id", "left_semi").select("tag_id", "log_id")


def assign_devices(logs: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows without a device get the one that is named like their host; others keep theirs."""
    names = devices.where("device_name <> ''").groupBy(F.col("device_name").alias("__host")).agg(F.min("device_id").alias("__device"))
    out = logs.join(broadcast_if_small(names), F.trim("hostname") == F.col("__host"), "left")
    return out.withColumn("device_id", F.when(F.coalesce("device_id", F.lit(0)) == 0, F.coalesce("__device", F.lit(0))).otherwise(F.col("device_id"))).drop("__host", "__device")


def new_devices(logs: DataFrame, devices: DataFrame, palette: int = 8) -> DataFrame:
    """A device for each host of unassigned rows that has none: ids follow the greatest, colours go round."""
    hosts = logs.where("coalesce(device_id, 0) = 0 AND trim(hostname) <> ''").select(F.trim("hostname").alias("device_name")).distinct()
    hosts = hosts.join(devices.select("device_name"), "device_name", "left_anti")
    last = devices.agg(F.coalesce(F.max("device_id"), F.lit(0)).alias("last"), F.count("*").alias("count"))
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("device_name"))
    # one row for each new host
    return hosts.withColumn("r", at).crossJoin(F.broadcast(last)).select((F.col("last") + F.col("r")).alias("device_id"), "device_name", F.pmod(F.col("count") + F.col("r") - 1, F.lit(palette)).cast("int").alias("color"))


def file_conflicts(new: DataFrame, existing: DataFrame, mode: str) -> DataFrame:
    """``name, stored_as, action`` for files that are to be imported; ``mode`` is skip, overwrite or rename.

    Names that are there already, or come more than once, are left out, replaced, or numbered from _2 on.
    """
    bare: Column = F.regexp_replace("name", r"^\[[^\]]*\]_", "")
    there = existing.select(bare.alias("bare")).distinct().withColumn("there", F.lit(True))
    rows = new.withColumn("bare", bare).join(there, "bare", "left").withColumn("r", F.row_number().over(Window.partitionBy("bare").orderBy("name")))
    place = F.col("r") + F.when(F.col("there"), 1).otherwise(0)
    numbered = F.when(place == 1, F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"(\.[^.]*)$", ""), F.lit("_"), place.cast("string"), F.regexp_extract("name", r"(\.[^.]*)$", 1)))
    if mode == "rename":
        return rows.select("name", numbered.alias("stored_as"), F.when(place == 1, "import").otherwise("rename").alias("action"))
    other = "skip" if mode == "skip" else "overwrite"
    return rows.select("name", F.col("name").alias("stored_as"), F.when(F.col("there"), other).when(F.col("r") > 1, "skip").otherwise("import").alias("action"))


def recent(views: DataFrame, most: int = 50) -> DataFrame:
    """The latest view of each entry, the ``most`` latest of them for each user."""
    last = views.groupBy("user_id", "knowledge_id").agg(F.max("viewed").alias("viewed"))
    w = Window.partitionBy("user_id").orderBy(F.desc("viewed"), "knowledge_id")
    return last.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def orphans(knowledge: DataFrame, mappings: DataFrame, document_id: int) -> DataFrame:
    """Entries that a document's deletion leaves without any mapping, and that aren't local."""
    lost = mappings.where(F.col("document_id") == document_id).select(F.col("knowledge_id").alias("id")).distinct()
    still = mappings.where(F.col("document_id") != document_id).select(F.col("knowledge_id").alias("id")).distinct()
    return knowledge.where(F.coalesce("source", F.lit("")) != "local").join(lost, "id", "left_semi").join(still, "id", "left_anti")
