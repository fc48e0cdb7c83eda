"""What several training-data operators share: Arrow text access, tables in the shared folder, hold-out columns."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(name: str) -> None:
    """Functions of module ``name`` travel to the executors inside the plan, so that these need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


#: Rows of one key from which it counts as hot, and the most keys that can be: their rows are joined where they lie.
HOT_ROWS, HOT_KEYS = 1000, 100_000
#: Rows of an id list that is broadcast, and the most bytes of an id there; longer lists are shuffled.
LISTED, ID_BYTES = 500_000, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one on a local master where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='syslumen-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


class Shared:
    """Parquet tables in the shared folder, each written once and read back: lineage ends there.

    ``drop`` removes one early; whatever is left goes when the interpreter ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/syslumen-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(f"{self.base}/{name}")

    def drop(self, name: str) -> None:
        self._delete(f"{self.base}/{name}")

    def clear(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        if self.spark.sparkContext._jsc is None or self.spark.sparkContext._jsc.sc().isStopped():
            return
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """The inner (or left) join of ``rows`` with ``keyed``, which has each key once, and in ``weight`` the rows of it.

    Keys of more than ``HOT_ROWS`` rows, and more than a share of 1 / ``HOT_KEYS``, go to where their rows lie, so that these
    don't meet in one task; by their weight there are fewer than ``HOT_KEYS``. ``keyed`` should be a written table.
    """
    total, most = keyed.agg(F.sum(weight), F.max(weight)).head()
    floor = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= floor:
        return rows.join(keyed.drop(weight), on, how)
    hot, cold = keyed.where(F.col(weight) > floor).drop(weight), keyed.where(F.col(weight) <= floor).drop(weight)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def listed(shared: Shared, ids: DataFrame, name: str) -> DataFrame:
    """``ids`` (a first column of ids, others of fixed size) written; marked for broadcast if its size is bounded."""
    ids = shared.write(ids, name)
    count, longest = ids.agg(F.count("*"), F.max(F.octet_length(ids[ids.columns[0]].cast("string")))).head()
    return F.broadcast(ids) if count <= LISTED and (longest or 0) <= ID_BYTES else ids


def of_list(df: DataFrame, ids: DataFrame, key: str, text: str, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join of whole rows with a list of ``doc_id`` and ``h``, the hash of the text; nulls are equal."""
    id_, h = fresh(df, "doc_id_", "h_")
    ids = ids.select(F.col("doc_id").alias(id_), F.col("h").alias(h))
    return df.join(ids, F.col(f"`{key}`").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(h)), how)


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: what the hold-out folds are made from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")), F.lit(divisor))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``n + 1`` offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (one row at least), so that memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def map_whole(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: str = "") -> DataFrame:
    """``f`` over batches of all columns, which it finds by place as c0, c1, ... and gives back with those of ``more`` after them.

    Names go around ``mapInArrow``, which can't take those with dots.
    """
    names = [f"c{k}" for k in range(len(df.columns))]
    plain = df.toDF(*names)
    schema = ", ".join([*(f"{n} {x.dataType.simpleString()}" for n, x in zip(names, df.schema, strict=True)), *([more] if more else [])])
    made = plain.mapInArrow(f, schema)
    return made.toDF(*df.columns, *made.columns[len(names) :])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def file_bytes(path: str) -> bytes:
    """A small file (a vocabulary) on the driver; its bytes go along with the plan."""
    if os.path.getsize(path) > 64 << 20:
        raise ValueError(f"{path} is over 64 MiB: too large to send with a plan")
    with open(path, "rb") as f:
        return f.read()
