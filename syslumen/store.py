"""Small files in the folder that driver and executors share: each is there whole or not at all, and the first writer wins.

Spark's writers commit through one temporary folder under their target, so that two of them at once on one folder can
lose each other's rows. What several drivers may write at one time (states of jobs, pointers to indexes) is a file of its own
here, put into place by one step that fails if the name is taken: a hard link on a file system that every driver mounts, and
elsewhere a rename that doesn't replace (as of HDFS; object stores without such a rename aren't fit for it).
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _local(spark: SparkSession, path: str) -> str | None:
    """The plain path of a file on a mounted file system; None elsewhere."""
    where, system = _system(spark, path)
    full = urlparse(where.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri().toString())
    return unquote(full.path) if full.scheme == "file" else None


def put_if_absent(spark: SparkSession, path: str, row: dict) -> bool:
    """Writes ``row`` as JSON under a name that nobody has; False if somebody has it."""
    folder, name = path.rsplit("/", 1)
    local = _local(spark, folder)
    # names that begin with a dot are not read by Spark
    temporary = f".{name}-{uuid.uuid4().hex}"
    if local is not None:
        os.makedirs(local, exist_ok=True)
        with open(f"{local}/{temporary}", "w") as f:
            f.write(json.dumps(row))
        try:
            os.link(f"{local}/{temporary}", f"{local}/{name}")
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{local}/{temporary}")
        return True
    replace(spark, f"{folder}/{temporary}", row)
    source, system = _system(spark, f"{folder}/{temporary}")
    target, _ = _system(spark, path)
    done = not system.exists(target) and system.rename(source, target)
    if not done:
        system.delete(source, False)
    return bool(done)


def replace(spark: SparkSession, path: str, row: dict) -> None:
    """Writes ``row`` as JSON, over what was there."""
    where, system = _system(spark, path)
    out = system.create(where, True)
    out.write(bytearray(json.dumps(row).encode()))
    out.close()


def names(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """The names of the files in a folder and when each was changed, in milliseconds; none if the folder isn't there."""
    where, system = _system(spark, folder)
    if not system.exists(where):
        return []
    return [(f.getPath().getName(), f.getModificationTime()) for f in system.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(".")]


def rows(spark: SparkSession, folder: str, schema: str, suffix: str = ".json") -> DataFrame:
    """All rows of the files with a suffix in a folder."""
    if not any(n.endswith(suffix) for n, _ in names(spark, folder)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", f"*{suffix}").json(folder)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder with all that is in it, if it is there."""
    where, system = _system(spark, path)
    system.delete(where, True)
