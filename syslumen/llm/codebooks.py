"""Codes for vectors: each of sixteen parts is named by the nearest entry of its own codebook, which a few rounds improve.

Components become integers (the floor of a scaled value), so that every sum is exact and no order of rows, tasks or retries
changes a code. A round broadcasts one kd-tree per codebook, finds the nearest entry of each part by branch and bound, sums parts
by entry within each task, and adds the tasks' sums; the driver sees one row an entry and gives each its floored mean. Subtrees
whose bound equals the best distance are visited as well, since they may hold an entry of that distance and a lower index.

Defined results: vectors that are null or hold a null or a value that isn't finite are left out, and so are those whose length
isn't the one that most of the others have (of equally many the longest) or can't be cut evenly; a null id is coded like any
other, but isn't among the first entries; of rows with one id those with the lesser vector come first; fewer rows than entries give
fewer entries; an empty table gives no rows. Scaled components of 2**28 or more are refused with a ValueError, as sums of their squares
need more than 64 bits. Columns of other names are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syslumen.llm import _common as C

C.by_value(__name__)

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf, and numbers that are looked at together.
LEAF, BLOCK = 6, 1 << 20
#: Scaled components below this have squared distances of 64 bits.
LARGEST = 1 << 28


#: A box around entries: its corners, and the entries of a leaf or the two halves. Plain tuples travel to executors without this package.
Node = tuple


def _bound(node: Node, q: np.ndarray) -> np.ndarray:
    """The squared distance of each point to the box."""
    away = np.maximum(node[0] - q, 0) + np.maximum(q - node[1], 0)
    return (away * away).sum(axis=1)


def tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook: halves by the median of the widest side."""
    entries = np.arange(len(book)) if entries is None else entries
    own = book[entries]
    low, high = own.min(axis=0), own.max(axis=0)
    if len(entries) <= LEAF or not own.shape[1]:
        return low, high, entries, None, None
    side = int(np.argmax(high - low))
    order = entries[np.argsort(own[:, side], kind="stable")]
    return low, high, None, tree(book, order[: len(order) // 2]), tree(book, order[len(order) // 2 :])


def nearest(book: np.ndarray, root: Node, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The index of the nearest entry of each row of ``q``, ties to the lower one, its squared distance, and how many distances were worked out."""
    index, best, looked = np.full(len(q), len(book)), np.full(len(q), np.iinfo("int64").max), 0

    def visit(node: Node, rows: np.ndarray) -> None:
        nonlocal looked
        _, _, entries, left, right = node
        if not len(rows):
            return
        if entries is not None:
            looked += len(rows) * len(entries)
            for e in entries:
                away = q[rows] - book[e]
                d = (away * away).sum(axis=1)
                better = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
                index[rows[better]], best[rows[better]] = e, d[better]
            return
        to_left, to_right = _bound(left, q[rows]), _bound(right, q[rows])
        # the nearer half first; the other one where its bound is no more than the best so far
        first = to_left <= to_right
        for near, far, own, bound in ((left, right, rows[first], to_right[first]), (right, left, rows[~first], to_left[~first])):
            visit(near, own)
            visit(far, own[bound <= best[own]])

    visit(root, np.arange(len(q)))
    return index, best, looked


def trees(books: list[np.ndarray]) -> list[tuple[np.ndarray, Node]]:
    return [(b.copy(), tree(b)) for b in books]


def integers(df: DataFrame, vector: str = "embedding", scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """The rows that can be coded, with ``v``: their components as integers."""
    (v,) = C.fresh(df, "v")
    x = F.col(f"`{vector}`")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    sizes = df.where(sound).groupBy(F.size(x).alias("n")).agg(F.count("*").alias("rows")).where(f"n % {parts} = 0")
    # lengths of vectors are few, but that isn't known: only the one wanted comes to the driver
    most = sizes.orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    width = most[0]["n"] if most else -1
    scaled = lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("int")
    small = F.forall(x, lambda c: F.abs(F.lit(float(scale)) * c.cast("double")) < LARGEST)
    made = F.when(small, F.transform(x, scaled)).otherwise(F.raise_error(F.lit(f"components of {LARGEST} or more after scaling: scale them down")))
    return df.where(sound & (F.size(x) == width)).withColumn(v, made)


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded size with their vectors as rows of a matrix."""
    for batch in batches:
        if batch.num_rows:
            n = max(1, BLOCK // max(1, len(batch.column(at)[0])))
            for k in range(0, batch.num_rows, n):
                part = batch.slice(k, n)
                flat = part.column(at).flatten().to_numpy(zero_copy_only=False).astype("int64")
                yield part, flat.reshape(part.num_rows, -1)


def _codes(told: list[tuple[np.ndarray, Node]], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = v.shape[1] // len(told)
    found = [nearest(book, root, v[:, p * width : (p + 1) * width]) for p, (book, root) in enumerate(told)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def sums(rows: DataFrame, told, parts: int) -> DataFrame:
    """``part, entry, n, total`` over all rows of one column of integer vectors: tasks add up for themselves what they can."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = None
        for _, v in _blocks(batches, 0):
            width = v.shape[1] // parts
            if n is None:
                entries = len(told.value[0][0])
                n, total = np.zeros((parts, entries), "int64"), np.zeros((parts, entries, width), "int64")
            code, _ = _codes(told.value, v)
            for p in range(parts):
                np.add.at(total[p], code[:, p], v[:, p * width : (p + 1) * width])
                n[p] += np.bincount(code[:, p], minlength=n.shape[1])
        if n is not None:
            part, entry = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype("int32")), pa.array(entry.astype("int32")), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    added = rows.mapInArrow(add, "part int, entry int, n bigint, total array<bigint>")
    # sums of tasks can pass 64 bits together
    long = added.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    return long.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(28,0)")).alias("x"))


def first_books(rows: DataFrame, key: str, v: str, parts: int, entries: int) -> list[np.ndarray]:
    """Parts of the vectors with the smallest ids."""
    found = [r[0] for r in rows.where(F.col(key).isNotNull()).orderBy(key, v).select(v).limit(entries).collect()]
    if not found:
        return []
    return list(np.array(found, dtype="int64").reshape(len(found), parts, -1).transpose(1, 0, 2))


def train(rows: DataFrame, key: str = "c0", v: str = "v", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part, from all rows."""
    books, spark = first_books(rows, key, v, parts, entries), rows.sparkSession
    for _ in range(rounds if books else 0):
        told = spark.sparkContext.broadcast(trees(books))
        # parts x entries x width numbers, whatever the number of rows
        for r in sums(rows.select(v), told, parts).collect():
            books[r["part"]][r["entry"], r["at"]] = int(r["x"]) // r["n"]
        told.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, error`` of every row that can be coded, and the codebooks that ``decode`` needs."""
    own = df.select(F.col(f"`{key}`").alias("c0"), F.col(f"`{label}`").alias("c1"), F.col(f"`{vector}`").alias("c2"))
    rows = C.Shared(df.sparkSession).write(integers(own, "c2", scale, parts).select("c0", "c1", "v"), "integers")
    books = train(rows, "c0", "v", parts, entries, rounds)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("c0", "c1")]
    schema = f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint"
    if not books:
        # without an entry nothing can be coded: there are no rows, or none with an id
        return df.sparkSession.createDataFrame([], schema), books
    told = df.sparkSession.sparkContext.broadcast(trees(books))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _blocks(batches, 2):
            code, d = _codes(told.value, v)
            # two digits for up to 256 entries, as many as are needed beyond
            digits = max(2, len(f"{len(told.value[0][0]) - 1:x}"))
            names = ["".join(f"{e:0{digits}x}" for e in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(d.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(name, schema), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error`` beside each row: the errors of equal labels added, nulls together.

    A label may have any share of the rows: its sum is made within tasks first and goes to where the rows lie.
    """
    shared = C.Shared(coded.sparkSession)
    rows = shared.write(coded.withColumns({"none": F.col("label").isNull(), "name": F.coalesce(F.col("label").cast("string"), F.lit(""))}), "coded")
    told = shared.write(rows.groupBy("none", "name").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    return C.hot_join(rows, told, ["none", "name"], "n").drop("none", "name")


def decode(code: Column, books: list[np.ndarray], scale: int = SCALE) -> Column:
    """The vector that a code of two-digit indexes stands for: the middles of its entries' steps."""
    values = F.array(*(F.array(*(F.array(*(F.lit((int(x) + 0.5) / scale) for x in e)) for e in b)) for b in books))
    index = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.concat(*(F.get(F.get(values, F.lit(p)), index(p)) for p in range(len(books))))


def _round(k: int) -> str:
    """Assigns the parts by the codebooks ``b<k>`` and makes ``b<k+1>`` from them."""
    return f"""a{k} AS (
  SELECT vec_id, p.p, q, min([list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e]) AS n
  FROM parts p JOIN b{k} b ON b.p = p.p GROUP BY vec_id, p.p, q
), s{k} AS (
  SELECT p, n[2] AS e, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS k FROM a{k}, range(1, 65) r(i) WHERE i <= len(q) GROUP BY p, n[2], i
), m{k} AS (
  SELECT p, e, list((s - ((s % k) + k) % k) // k ORDER BY i) AS c FROM s{k} GROUP BY p, e
), b{k + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e
)"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS (
  SELECT vec_id, CAST(p AS BIGINT) AS p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS q FROM kept, range(16) r(p)
), b0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c FROM parts QUALIFY e < 64
), {_round(0)}, {_round(1)}, a2 AS (
  SELECT vec_id, p.p, min([list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e]) AS n
  FROM parts p JOIN b2 b ON b.p = p.p GROUP BY vec_id, p.p
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(n[2] AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(n[1]) AS BIGINT) AS error FROM a2 GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b2
)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id, books
"""
