"""Listing files and tasks' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST, HARD = 50_000, 200_000


def list_files(spark: SparkSession, paths: list[str], extensions: tuple[str, ...] = (), recursive: bool = True, most: int = MOST) -> tuple[DataFrame, bool]:
    """``path, length`` of files below the paths, without hidden folders, by path; and whether there are more than ``most``.

    Contents aren't read: the listing's columns are all that is asked for.
    """
    most = min(most or MOST, HARD)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths).select("path", "length")
    found = found.where(~F.col("path").rlike(r"/\.[^/]+/"))
    if extensions:
        found = found.where(F.lower("path").rlike("(" + "|".join(rf"\.{e.lower().lstrip('.')}" for e in extensions) + ")$"))
    cut = found.limit(most + 1).count() > most
    return found.orderBy("path").limit(most), cut


def task_logs(spark: SparkSession, path: str, task_id: str) -> DataFrame:
    """A task's rows: its partition alone is read."""
    return spark.read.parquet(path).where(F.col("task_id") == task_id)


def scan_packages(spark: SparkSession, paths: list[str], documents: DataFrame) -> DataFrame:
    """``path, name, kind, known``: archives and folders with a profile, and whether a document of that name is there already, whatever the case."""
    listed, _ = list_files(spark, paths)
    low = F.lower("path")
    archive = listed.where(low.rlike(r"\.(hdx|zip)$")).select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), F.lit("archive").alias("kind"))
    folder = listed.where(low.endswith("/profile.xml")).select(F.regexp_replace("path", "/[^/]+$", "").alias("path"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("name"), F.lit("folder").alias("kind"))
    there = documents.select(F.explode(F.array("lib_id", "name")).alias("n")).select(F.lower(F.trim("n")).alias("n")).where("n <> ''").distinct().withColumn("known", F.lit(True))
    return archive.union(folder).join(there, F.lower("name") == F.col("n"), "left").select("path", "name", "kind", F.coalesce("known", F.lit(False)).alias("known"))
