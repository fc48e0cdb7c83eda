"""Operator 8: approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

Vectors are scaled to length one, so that the nearest by angle are the nearest by distance, and are
hashed in ``TABLES`` tables by ``m`` projections on normal vectors, each shifted and cut into slots of
width ``WIDTH``. A query visits its own bucket and then those of the perturbation sets (steps to a next
slot of some projections) of the least estimated cost, the sum of squared distances to the slots'
borders. The number of projections and of sets is fitted: the most projections, and the least of
``PROBES``, with which a sample of at most ``SAMPLE`` queries finds the share ``RECALL`` of its true
neighbours, which a scan of all rows gives. So data without structure get larger buckets, not more visits. Candidates of all tables are merged and ranked by the exact cosine of the original
vectors in double precision.

Rows and probes meet by a hash of table and bucket in groups of about ``GROUP`` rows, so that a group
fits a task; a bucket that is larger is split over several groups, each of which its probes visit, and one that more than
``ASKED`` queries visit meets them in as many parts: a task has one split and one part, and no candidate is dropped. Rows with the same vector are hashed once: only the ``k + 1`` smallest ids of
them can be an answer. A query for which the tables give fewer than ``k`` candidates is compared with
all rows instead, ``BLOCK`` such queries at a time.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows with a null id; equal scores rank by the smaller id;
repeated ids count once, with their least vector; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syslumen.llm import _common as C

C.by_value(__name__)

TABLES = 6
#: Numbers of perturbation sets that fitting chooses from, and the recall that the choice is made for.
PROBES = (5, 10, 20, 40, 80)
RECALL = 0.96
#: Queries of the sample that the number is chosen by.
SAMPLE = 256
WIDTH = 1.5
#: Rows that a bucket holds on average at least, from which the most projections follow.
BUCKET = 24
GROUP = 20_000
#: Queries of a bucket that meet its rows in one task.
ASKED = 4096
BLOCK = 4096
#: Pairs of a query and a row whose distance a task works out at a time.
PAIRS = 1 << 15


class Hasher:
    """The projections of every table."""

    def __init__(self, dim: int, m: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.m = m
        self.a = rng.normal(size=(dim, TABLES * self.m))
        self.b = rng.uniform(0, WIDTH, TABLES * self.m)
        self.mix = rng.integers(1, 1 << 62, self.m, dtype=np.int64) | 1

    def slots(self, x: np.ndarray) -> np.ndarray:
        """Positions in units of slots: (rows, tables, projections)."""
        return ((x @ self.a + self.b) / WIDTH).reshape(len(x), TABLES, self.m)

    def buckets(self, slots: np.ndarray) -> np.ndarray:
        """A number for each bucket (rows, tables)."""
        with np.errstate(over="ignore"):
            h = (np.floor(slots).astype(np.int64) * self.mix).sum(-1) + np.arange(1, TABLES + 1) * np.int64(0x5851F42D4C957F2D)
            h ^= (h.view(np.uint64) >> np.uint64(33)).view(np.int64)
            return h * np.int64(0x2545F4914F6CDD1D)

    def probes(self, slots: np.ndarray, count: int) -> np.ndarray:
        """Buckets to visit for each row and table, the likeliest first: (rows, tables, 1 + count)."""
        step = max(1, PAIRS // (4 * TABLES * count))
        return np.concatenate([self._probes(slots[k : k + step], count) for k in range(0, len(slots), step)])

    def _probes(self, slots: np.ndarray, count: int) -> np.ndarray:
        n = slots.shape[0] * TABLES
        own = np.floor(slots).reshape(n, self.m)
        part = slots.reshape(n, self.m) - own
        # costs of a step down and of a step up, cheapest first
        cost = np.concatenate([part, 1 - part], axis=1) ** 2
        order = np.argsort(cost, axis=1)
        cost = np.take_along_axis(cost, order, 1)
        sets = self.sets(3 * count)
        total = np.stack([cost[:, list(s)].sum(1) for s in sets], axis=1)
        # a projection can't step both ways
        for k, s in enumerate(sets):
            if len(s) > 1:
                which = order[:, list(s)] % self.m
                which.sort(1)
                total[(which[:, 1:] == which[:, :-1]).any(1), k] = np.inf
        best = np.argsort(total, axis=1)[:, :count]
        out = np.repeat(own[:, None], best.shape[1] + 1, axis=1)
        # a set's members as a fixed number of steps, of which some are none
        wide = max(map(len, sets))
        table = np.array([[*s, *[2 * self.m] * (wide - len(s))] for s in sets])
        chosen = table[best]
        padded = np.concatenate([order, np.full((n, 1), -1)], axis=1)
        step = np.take_along_axis(padded, chosen.reshape(n, -1), 1).reshape(chosen.shape)
        rows, cols, _ = np.nonzero(step >= 0)
        which = step[step >= 0]
        np.add.at(out, (rows, cols + 1, which % self.m), np.where(which < self.m, -1, 1))
        valid = np.concatenate([np.ones((n, 1), bool), np.isfinite(np.take_along_axis(total, best, 1))], axis=1)
        found = self.buckets(out.reshape(len(slots), TABLES, -1, self.m).transpose(0, 2, 1, 3).reshape(-1, TABLES, self.m)).reshape(len(slots), -1, TABLES).transpose(0, 2, 1)
        return np.where(valid.reshape(found.shape), found, 0)

    def sets(self, count: int) -> list[tuple[int, ...]]:
        """Sets of ranks among sorted costs, by expected cost, made from the first by shifting or adding a step."""
        import heapq

        expected = [(k + 1) * (k + 2) / (4 * (self.m + 1) * (self.m + 2)) if k < self.m else 1 - (2 * self.m - k) / (self.m + 1) + (2 * self.m - k) * (2 * self.m + 1 - k) / (4 * (self.m + 1) * (self.m + 2)) for k in range(2 * self.m)]
        heap, out = [(expected[0], (0,))], []
        while heap and len(out) < count:
            cost, s = heapq.heappop(heap)
            out.append(s)
            last = s[-1]
            if last + 1 < 2 * self.m:
                heapq.heappush(heap, (cost - expected[last] + expected[last + 1], (*s[:-1], last + 1)))
                heapq.heappush(heap, (cost + expected[last + 1], (*s, last + 1)))
        return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _clean(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Rows ``id, v`` that take part, each id once, and the vectors' length."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("v"), v.alias("d")).where("id is not null and size(d) > 0")
    rows = rows.where(F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("d", lambda x: x != 0)).drop("d")
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not sizes:
        return rows.limit(0), 1
    return rows.where(F.size("v") == sizes[0]["n"]).groupBy("id").agg(F.min("v").alias("v")), sizes[0]["n"]


def _topk(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query, best first."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


class Best:
    """The k best rows found so far for each of some queries; members: the ids that share a vector."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, members: pa.Array, x: np.ndarray, k: int):
        self.ids, self.q, self.x, self.k = ids, q, x, k
        self.qn, self.xn = (v / np.sqrt((v * v).sum(1, keepdims=True)) for v in (q, x))
        self.flat, self.ends = members.values.to_numpy(), members.offsets.to_numpy().astype(np.int64)
        self.least = np.full(len(q), -2.0)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def look(self, qs: np.ndarray, xs: np.ndarray) -> None:
        """Compares these queries with these vectors."""
        step = max(1, 16 * PAIRS // max(len(qs), 1))
        for at in range(0, len(xs), step):
            part = xs[at : at + step]
            qi, xi = np.nonzero(self.qn[qs] @ self.xn[part].T >= self.least[qs][:, None] - 1e-9)
            self.waiting.append((qs[qi], part[xi]))
            self.held += len(qi)
            if self.held >= PAIRS:
                self.settle()

    def settle(self) -> None:
        qi, xi = (np.concatenate(p) for p in zip(*self.waiting, strict=True)) if self.waiting else (np.zeros(0, np.int64),) * 2
        self.waiting, self.held = [], 0
        score = np.concatenate([_cosine(self.q[qi[a : a + PAIRS]], self.x[xi[a : a + PAIRS]]) for a in range(0, len(qi), PAIRS)] or [np.zeros(0)])
        size = (self.ends[1:] - self.ends[:-1])[xi]
        at = np.repeat(self.ends[xi] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        qi, ids, score = np.repeat(qi, size), self.flat[at], np.repeat(score, size)
        other = self.ids[qi] != ids
        qi, ids, score = (np.concatenate([a, b[other]]) for a, b in zip(self.found, (qi, ids, score), strict=True))
        order = np.lexsort((ids, qi))
        again = np.append(False, (qi[order][1:] == qi[order][:-1]) & (ids[order][1:] == ids[order][:-1]))
        once = order[~again[: len(order)]]
        best = once[_topk(qi[once], ids[once], score[once], self.k)]
        self.found = (qi[best], ids[best], score[best])
        full = np.bincount(qi[best], minlength=len(self.q)) >= self.k
        low = np.full(len(self.q), 2.0)
        np.minimum.at(low, qi[best], score[best])
        self.least = np.where(full, low, self.least)

    def table(self) -> pa.Table:
        self.settle()
        return pa.table({"query_id": pa.array(self.ids[self.found[0]], pa.int64()), "vec_id": pa.array(self.found[1], pa.int64()), "score": self.found[2]})


_OUT = "query_id bigint, vec_id bigint, score double"


def _fitted(count: int, truth: DataFrame, asked: DataFrame, packed: DataFrame, dim: int) -> tuple[Hasher, int]:
    """The projections, and how many perturbation sets to visit, that find ``RECALL`` of the sample's true neighbours."""
    most = int(np.clip(np.ceil(np.log(max(count, 2) / BUCKET) / np.log(3.0)), 2, 24))
    pairs = truth.collect()
    if not pairs:
        return Hasher(dim, most), PROBES[0]
    vectors = {r["id"]: r["v"] for r in asked.collect()}
    wanted = asked.sparkSession.createDataFrame([(r["vec_id"],) for r in pairs], "id bigint").distinct()
    near = {r["id"]: r["v"] for r in packed.select("v", F.explode("ids").alias("id")).join(F.broadcast(wanted), "id").collect()}
    unit = lambda rows: (lambda x: x / np.sqrt((x * x).sum(1, keepdims=True)))(np.array(rows, np.float64).reshape(-1, dim))
    names = sorted(vectors)
    of = np.searchsorted(names, [r["query_id"] for r in pairs])
    x, y = unit([vectors[k] for k in names]), unit([near[r["vec_id"]] for r in pairs])
    for m in range(most, 0, -1):
        hasher = Hasher(dim, m)
        slots, seen = hasher.slots(x), hasher.buckets(hasher.slots(y))
        for sets in PROBES:
            probes = hasher.probes(slots, sets)
            if np.mean([(probes[q] == s[:, None]).any() for q, s in zip(of, seen, strict=True)]) >= RECALL:
                return hasher, sets
    return hasher, PROBES[-1]


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries``, its k nearest found among the other rows of ``df``."""
    spark = df.sparkSession
    shared = C.Shared(spark)
    rows, dim = _clean(df, key, vector)
    rows = shared.write(rows, "rows")
    # of equal vectors, the k + 1 smallest ids: ids are first kept apart by a hash, so that no group is in one task
    salted = rows.select("v", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("s"))
    few = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    ranked = Window.partitionBy("v", "s").orderBy("id")
    packed = salted.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).groupBy("v").agg(few(F.collect_list("id")).alias("ids"))
    packed = shared.write(packed, "distinct")
    asked, asked_dim = _clean(queries, key, vector)
    asked = shared.write(asked if asked_dim == dim else asked.limit(0), "queries")
    count = packed.count()
    some = asked.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) <= F.lit(int(min(1.0, SAMPLE / max(asked.count(), 1)) * (1 << 20))))
    some = shared.write(some, "sample")
    hasher, probes = _fitted(count, _scan(packed, some, dim, k, shared, "sample"), some, packed, dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(0), dim)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(hasher.buckets(hasher.slots(x))), pa.list_(pa.int64()))], names=["v", "ids", "buckets"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = _vectors(part.column(1), dim)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                found = hasher.probes(hasher.slots(x), probes).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([np.unique(f[f != 0]) for f in found], pa.list_(pa.int64()))], names=["id", "v", "buckets"])

    kind = packed.schema["v"].dataType.simpleString()
    points = packed.mapInArrow(index, f"v {kind}, ids array<bigint>, buckets array<bigint>").select("v", "ids", F.explode("buckets").alias("bucket"))
    points = shared.write(points, "points")
    # a bucket of more than GROUP rows is split
    large = points.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("bucket", F.ceil(F.col("n") / F.lit(GROUP)).cast("int").alias("splits"))
    large = shared.write(large, "large")
    groups = max(1, -(-count * TABLES // GROUP))
    group = lambda: F.pmod(F.xxhash64("bucket", "split", "part"), F.lit(groups))
    visits = shared.write(asked.mapInArrow(probe, f"id bigint, v {kind}, buckets array<bigint>"), "visits")
    busy = visits.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > ASKED)
    busy = shared.write(busy.select("bucket", F.ceil(F.col("n") / F.lit(ASKED)).cast("int").alias("parts")), "busy")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    dealt = lambda n, by: F.pmod(F.xxhash64(by), F.coalesce(n, F.lit(1))).cast("int")
    # rows go to one split and all parts of their bucket, queries to one part and all splits
    left = points.join(large, "bucket", "left").join(busy, "bucket", "left").withColumn("split", dealt("splits", "v")).withColumn("part", every("parts")).select(group().alias("g"), "bucket", "v", "ids")
    right = visits.select("id", "v", F.explode("buckets").alias("bucket")).join(large, "bucket", "left").join(busy, "bucket", "left").withColumn("part", dealt("parts", "id")).withColumn("split", every("splits"))
    # of a query's probes into one group, its vector goes along once
    right = right.groupBy(group().alias("g"), "id").agg(F.first("v").alias("v"), F.collect_set("bucket").alias("buckets"))

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        best = Best(q.column("id").to_numpy(), _vectors(q.column("v"), dim), x.column("ids").combine_chunks() if x.num_rows else pa.array([], pa.list_(pa.int64())), _vectors(x.column("v"), dim), k)
        bucket = x.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        lists = q.column("buckets").combine_chunks() if q.num_rows else pa.array([], pa.list_(pa.int64()))
        visits, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        by = np.argsort(visits, kind="stable")
        visits, of = visits[by], of[by]
        start = np.flatnonzero(np.append(True, visits[1:] != visits[:-1])) if len(visits) else np.zeros(0, np.int64)
        low, high = (np.searchsorted(bucket, visits[start], side=s) for s in ("left", "right"))
        for a, b, lo, hi in zip(start, np.append(start[1:], len(visits))[: len(start)], low, high, strict=True):
            if lo < hi:
                best.look(of[a:b], order[lo:hi])
        return best.table()

    found = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(meet, _OUT).distinct()  # a pair's score is the same in each table
    found = shared.write(found, "found")
    short = asked.join(found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= min(k, max(count - 1, 0))), "id", "left_anti")
    found = found.union(_scan(packed, shared.write(short, "short"), dim, k, shared, "short"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(packed: DataFrame, queries: DataFrame, dim: int, k: int, shared: C.Shared, name: str) -> DataFrame:
    """Exact answers of these few queries, in blocks that each pass over all rows."""
    count = queries.count()
    blocks = -(-count // BLOCK)
    out = packed.sparkSession.createDataFrame([], _OUT)
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        ids, q = np.array([r["id"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64).reshape(-1, dim)

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                members = batch.column(1).take(pa.array(np.arange(batch.num_rows)))
                best = Best(ids, q, members, _vectors(batch.column(0), dim), k)
                best.look(np.arange(len(q)), np.arange(batch.num_rows))
                yield from best.table().to_batches()

        if len(own):
            # written at once, so that the driver holds the queries of one block only
            out = out.union(shared.write(packed.select("v", "ids").mapInArrow(run, _OUT), f"scan-{name}-{block}"))
    return out
