"""Operator 2: quality classifier on random Fourier features of document statistics.

Each text becomes a row of statistics (``statistics``: shares of kinds of characters, lengths of words
and lines, repetition), made from its bytes alone. Standardised, they pass through ``FEATURES`` random
cosines, whose products approximate a Gaussian kernel. Ridge regression on them is fitted from normal
equations that each partition sums for its own rows; one row of them for each feature is then summed by
key, so that what reaches the driver has a fixed size. Isotonic regression on rows kept out of the
normal equations turns raw scores into probabilities; between its steps scores are interpolated.

Labels come from rows of the labels table whose fold allows it. At most about ``TRAIN`` labelled rows
are fitted on, chosen by a hash; that bound concerns labels only, every text is scored.

Defined cases: a null text counts as empty; an empty text is scored from its statistics like any other;
rows of the labels table that are repeated for a document count once (the smallest label); labels that
are null aren't learned from; without any label every score is 0.5; with one class only, that class's
share; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syslumen.llm import _common as C

C.by_value(__name__)

FEATURES = 192
#: Bound on the labelled rows that are fitted on.
TRAIN = 200_000
RIDGE = 1e-4
#: Of the labelled rows, those with this remainder modulo 4 are for calibration.
CALIBRATE = 0
#: Steps of the raw score that calibration counts by.
STEPS = 2048
BLOCK = 2048

_KINDS = 10


def _classes() -> np.ndarray:
    """A kind for each byte: lower, upper, digit, blank, line end, sentence end, other pause, quote or bracket, symbol, beyond ASCII."""
    kind = np.full(256, 8, np.uint8)
    for k, chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".!?", b",;:-", b"\"'()[]{}"]):
        kind[list(chars)] = k
    kind[0x80:] = 9
    return kind


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text, from its UTF-8 bytes; shares lie in 0..1 and lengths are logarithms."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kind = _classes()[raw]
    whose = np.repeat(np.arange(n, dtype=np.int32), size)
    shares = np.bincount(whose * np.int32(_KINDS) + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float64)
    total = np.maximum(size, 1)[:, None]

    def pieces(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and owners of the runs of ``inside``, cut where texts meet."""
        before = np.zeros(len(raw), bool)
        if len(raw):
            before[1:] = inside[:-1]
            before[offsets[:-1][size > 0]] = False
        start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(raw), bool)
        if len(raw):
            after[:-1] = inside[1:]
            after[offsets[1:][size > 0] - 1] = False
        return start, np.flatnonzero(inside & ~after) + 1, whose[start]

    # arrays as long as the text are kept to 32 bits, as they are what memory goes into
    mixed = ((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)[raw]
    place = np.arange(len(raw), dtype=np.uint32)

    def runs(inside: np.ndarray) -> tuple[np.ndarray, ...]:
        start, end, owner = pieces(inside)
        count = np.bincount(owner, minlength=n).astype(np.float64)
        length = (end - start).astype(np.float64)
        mean = np.bincount(owner, length, n) / np.maximum(count, 1)
        spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / np.maximum(count, 1) - mean**2, 0))
        # a piece's value: its bytes mixed with their place in it, summed
        inner = place[inside] - np.repeat(start.astype(np.uint32), end - start)
        inner *= np.uint32(2)
        inner += np.uint32(1)
        part = mixed[inside] * inner
        del inner
        part ^= part >> np.uint32(15)
        length_ = (end - start).astype(np.int64)
        value = (np.add.reduceat(part, np.cumsum(length_) - length_) if len(start) else np.zeros(0, np.uint32)) * np.uint32(0xD6E8FEB9)
        order = np.lexsort((value, owner))
        v, o = value[order], owner[order]
        fresh = np.ones(len(v), bool)
        fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        distinct = np.bincount(o[fresh], minlength=n)
        often = np.diff(np.append(np.flatnonzero(fresh), len(v)))
        most = np.zeros(n)
        np.maximum.at(most, o[fresh], often)
        alike = np.zeros(len(value), bool)
        alike[1:] = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[alike], minlength=n)
        return start, end, owner, count, mean, spread, distinct / np.maximum(count, 1), most / np.maximum(count, 1), again / np.maximum(count, 1)

    words = runs((kind != 3) & (kind != 4))
    lines = runs(kind != 4)
    # words whose last byte is a symbol, whose first is upper case, that are all upper case, without a letter
    start, end, owner, count = words[:4]
    per = np.maximum(count, 1)
    summed = lambda flag: np.cumsum(np.append(False, flag), dtype=np.int32)
    letters, lower, upper = summed((kind <= 1) | (kind == 9)), summed(kind == 0), summed(kind == 1)
    of = lambda flag: np.bincount(owner[flag], minlength=n) / per
    marks = [
        of(kind[end - 1] == 8), of(kind[start] == 1), of((upper[end] - upper[start] > 1) & (lower[end] == lower[start])),
        of(letters[end] == letters[start]), of(end - start <= 2), of(end - start >= 16),
    ]
    share = shares / total
    filled = share > 0
    entropy = -(share * np.log(np.where(filled, share, 1))).sum(1)
    logs = [np.log1p(x) for x in (size, words[3], lines[3], words[4], words[5], lines[4], lines[5])]
    return np.column_stack([share, entropy, *logs, *words[6:9], *lines[6:9], *marks]).astype(np.float32)


def statistics_of(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, most=1 << 20):
            made = statistics(*C.utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(made), pa.list_(pa.float32()))], names=["doc_id", "stats"])

    kept = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, stats array<float>")


class Model:
    """Standardisation, random cosines, ridge weights, calibration: everything a score needs."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        # the width of the kernel follows the number of statistics: squared distances grow with it
        self.turn = rng.normal(size=(len(mean), FEATURES)) / np.sqrt(2.0 * len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1 + len(mean))
        self.at, self.to = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2.0 / FEATURES) * np.cos(z @ self.turn + self.phase), np.ones(len(z)), 0.1 * z])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(stats[k : k + BLOCK]) @ self.beta for k in range(0, len(stats), BLOCK)] or [np.zeros(0)])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.to), 0, 1)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the places and values of a non-decreasing fit, one for each pool."""
    pools: list[list[float]] = []
    for x, m, w in zip(at.tolist(), mean.tolist(), weight.tolist(), strict=True):
        pools.append([x * w, m * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    done = np.array(pools)
    return done[:, 0] / done[:, 2], done[:, 1] / done[:, 2]


def _labelled(stats: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Statistics with ``y`` and ``part`` (the calibration fold) of at most about ``TRAIN`` labelled rows."""
    one = labels.where(f"{label} is not null").groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    count = one.count()
    cut = min(1.0, TRAIN / max(count, 1))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(1 << 20))
    one = one.where(fold < F.lit(int(cut * (1 << 20)))) if cut < 1 else one
    return stats.join(one, "doc_id").select("stats", "y", F.pmod(fold, F.lit(4)).cast("int").alias("part"))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model for rows ``doc_id, stats`` and the labels of those of them that may be learned from."""
    shared = C.Shared(stats.sparkSession)
    rows = shared.write(_labelled(stats, labels, label), "labelled")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                own = np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

    sums = {r["k"]: r["v"] for r in rows.mapInArrow(moments, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    if not sums:
        none = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
        return Model(np.zeros(none), np.ones(none))
    width = (len(sums) - 1) // 2
    flat = np.array([sums[k] for k in range(len(sums))])
    mean = flat[1 : width + 1] / flat[0]
    model = Model(mean, np.sqrt(np.maximum(flat[width + 1 :] / flat[0] - mean**2, 1e-6)))
    calibrate, block = CALIBRATE, BLOCK

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = batch.column(2).to_numpy() != calibrate
            x, y = _matrix(batch.column(0))[own] if batch.num_rows else np.zeros((0, width)), batch.column(1).to_numpy()[own]
            for at in range(0, len(x), block):
                z = model.features(x[at : at + block])
                part = np.column_stack([z.T @ z, z.T @ y[at : at + block]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "v"])

    def added(table: pa.Table) -> pa.Table:
        return pa.table({"k": table.column("k")[:1], "v": pa.array([_matrix(table.column("v")).sum(0)], pa.list_(pa.float64()))})

    # a row of the equations at a time: each group holds one row from each partition
    made = rows.mapInArrow(equations, "k int, v array<double>").groupBy("k").applyInArrow(added, "k int, v array<double>").collect()
    if made:
        system = np.array([r["v"] for r in sorted(made, key=lambda r: r["k"])])
        left, right = system[:, :-1], system[:, -1]
        model.beta = np.linalg.solve(left + RIDGE * max(1.0, flat[0]) * np.eye(len(left)), right)

    steps = STEPS

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy() == calibrate
            if own.any():
                score = np.clip(np.floor((model.raw(_matrix(batch.column(0))[own]) + 1.0) * (steps / 3.0)), 0, steps)
                yield pa.RecordBatch.from_arrays([pa.array(score.astype(np.int32)), pa.array(batch.column(1).to_numpy()[own])], names=["k", "y"])

    bins = sorted(rows.mapInArrow(raw, "k int, y double").groupBy("k").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect(), key=lambda r: r["k"])
    if bins:
        n = np.array([r["n"] for r in bins], np.float64)
        at, to = isotonic((np.array([r["k"] for r in bins]) + 0.5) * 3.0 / steps - 1.0, np.array([r["y"] for r in bins]) / n, n)
        # beyond the outer pools scores still rise, to 0 and 1 far away
        model.at, model.to = np.concatenate([[min(-1.0, at[0]) - 1.0], at, [max(2.0, at[-1]) + 1.0]]), np.concatenate([[0.0], to, [1.0]])
        if len(set(to)) == 1:
            model.to[[0, -1]] = to[0]
    shared.drop("labelled")
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` for rows ``doc_id, stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), pa.array((made >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def fitted(df: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id") -> tuple[Model, DataFrame]:
    """The model that labelled rows whose fold (crc32 of the key modulo 3) isn't 1 give, and the statistics of all rows."""
    shared = C.Shared(df.sparkSession)
    stats = shared.write(statistics_of(df, text, key), "statistics")
    learn = labels.where(C.remainder("doc_id", 3) != 1).select("doc_id", F.col(label).alias("label"))
    return fit(stats, learn, "label"), stats


def classify(df: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores every row with the model that ``fitted`` gives."""
    model, stats = fitted(df, labels, label, text, key)
    return score(stats, model).select("doc_id", (C.remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def keep_good(df: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that aren't predicted to be of low quality; all columns stay.

    A row's score needs nothing but its text, so that rows are judged where they are read: their texts aren't
    shuffled to meet a list of ids. Rows with a null key are judged like any other.
    """
    # only what may be learned from is looked at twice
    learn = labels.where((C.remainder("doc_id", 3) != 1) & F.col(label).isNotNull()).select("doc_id").distinct()
    (labelled,) = C.fresh(df, "labelled_")
    learn = C.listed(C.Shared(df.sparkSession), learn.withColumnRenamed("doc_id", labelled), "learn")
    model, _ = fitted(df.join(learn, F.col(f"`{key}`") == F.col(labelled), "left_semi"), labels, label, text, key)

    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, f"c{at}", most=1 << 20):
            stats = statistics(*C.utf8(batch.column(at)))
            yield batch.filter(pa.array(model.score(stats.astype(np.float64)) >= 0.5))

    return C.map_whole(df, run)
