"""Operator 4: language identification with a string kernel.

Two texts' kernel is the number of distinct byte n-grams (lengths 1 to ``LONGEST``, of the lower-cased
text) that both hold, divided by the geometric mean of each text's own number: the blended-spectrum
presence kernel, normalised. N-grams are held as one of ``BUCKETS`` hash values.

Fitting takes a bounded sample: at most ``LANDMARKS`` landmarks and ``TRAIN`` training rows, shared evenly
over the languages and chosen by a hash of key and text; every language has one at least, however many there are. Nystroem features are the kernel with the landmarks
times the inverse square root of the landmarks' own kernel matrix; kernel ridge regression, one language
against the rest, is then ridge on those features. As the kernel is linear in a text's presence vector,
landmarks, square root and ridge weights fold into one matrix (buckets by languages), and a block of texts is
scored by one product of its sparse presence rows with that matrix, which takes half a MB for each language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; languages that are null are
not learned from; without any labelled row every text is ``und`` with score 0; repeated rows are scored
alike; an empty table gives none; columns other than text, lang and the key are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syslumen.llm import _common as C

C.by_value(__name__)

LONGEST = 4
BUCKETS = 1 << 17
#: Bounds of the sample that the model is fitted on, over all languages; with more languages than that, one row and one landmark of each.
LANDMARKS = 128
TRAIN = 2000
RIDGE = 1e-2
#: Softmax sharpness of the regression outputs (targets are -1 and 1).
SHARP = 4.0
#: Bytes hashed at a time, so that a very long text doesn't need much memory.
CHUNK = 1 << 20

_MULTIPLIER = np.uint32(0x9E3779B1)


def present(raw: np.ndarray, flags: np.ndarray) -> None:
    """Sets the flag of every n-gram of the bytes."""
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK + LONGEST - 1].astype(np.uint32) + np.uint32(1)
        h = part
        for n in range(1, LONGEST + 1):
            if n > 1:
                if len(part) < n:
                    break
                h = h[:-1] * np.uint32(257) + part[n - 1 :]
            flags[((h + np.uint32(n * 0x01000193)) * _MULTIPLIER) >> shift] = 1


def sparse_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present in each text, one after the other, and how many each has."""
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    flags = np.zeros(BUCKETS, np.uint8)
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b > a:
            flags[:] = 0
            present(raw[a:b], flags)
            found.append(np.flatnonzero(flags).astype(np.int32))
            counts[k] = len(found[-1])
    return (np.concatenate(found) if found else np.zeros(0, np.int32)), counts


def product(buckets: np.ndarray, counts: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The presence rows times a dense matrix."""
    out = np.zeros((len(counts), dense.shape[1]), dense.dtype)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(dense[buckets], (np.cumsum(counts) - counts)[full], axis=0)
    return out


def _presence(df: DataFrame) -> DataFrame:
    """``id``, ``lang`` and the packed presence bits of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = C.utf8(batch.column(1))
            packed = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                flags = np.zeros(BUCKETS, np.uint8)
                present(raw[a:b], flags)
                packed.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["lang", "bits"])

    return df.select("lang", "text").mapInArrow(run, "lang string, bits binary")


def sample(labelled: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """About ``most`` rows, shared evenly over the languages, by a hash of the text; and the languages.

    Each language's share of the hash range follows its number of rows, so no group is gathered to be sampled.
    The hash takes in the key, so that copies of one text aren't all sampled or none.
    """
    at = F.pmod(F.xxhash64("key", "text", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sizes = {r["lang"]: (r["n"], r["low"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(at).alias("low")).collect()}
    if not sizes:
        return labelled.limit(0), []
    share = most / len(sizes)
    cuts = [(k, max(min(1.0, share / n), low + 2.0**-21)) for k, (n, low) in sorted(sizes.items())]
    table = labelled.sparkSession.createDataFrame(cuts, "lang string, cut double")
    # rows that are alike in all of it count once, so that their number doesn't matter
    return labelled.join(F.broadcast(table), "lang").where(at < F.col("cut")).drop("cut").distinct(), [k for k, _ in cuts]


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages learned from ``lang`` and ``text`` (``key`` only steers the sample), and the matrix of buckets by languages."""
    labelled = labelled.where("lang is not null").select("lang", "key", F.coalesce(F.lower("text"), F.lit("")).alias("text"))
    picked, languages = sample(labelled, TRAIN)
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    rows = _presence(picked).collect()
    rows.sort(key=lambda r: (r["lang"], r["bits"]))
    lists = [np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))).astype(np.int32) for r in rows]
    own = np.array([max(1, len(x)) for x in lists], np.float64)
    target = np.array([[1.0 if r["lang"] == k else -1.0 for k in languages] for r in rows])
    each = max(1, LANDMARKS // len(languages))
    marks = [k for lang in languages for k in [i for i, r in enumerate(rows) if r["lang"] == lang][:: max(1, sum(r["lang"] == lang for r in rows) // each)][:each]]
    dense = np.zeros((BUCKETS, len(marks)), np.float32)
    for j, k in enumerate(marks):
        dense[lists[k], j] = 1.0 / np.sqrt(own[k])
    kernel = np.stack([dense[x].sum(0) for x in lists]).astype(np.float64) / np.sqrt(own)[:, None]
    values, vectors = np.linalg.eigh((kernel[marks] + kernel[marks].T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    # every language weighs the same, as its share of the sample may be small
    weight = np.array([len(rows) / (len(languages) * max(1, sum(r["lang"] == x["lang"] for r in rows))) for x in rows])
    mean = (weight[:, None] * target).sum(0) / weight.sum()
    left = features.T @ (weight[:, None] * features) + RIDGE * len(rows) * np.trace(features.T @ features) / len(rows) / features.shape[1] * np.eye(features.shape[1])
    beta = np.linalg.solve(left, features.T @ (weight[:, None] * (target - mean)))
    return languages, np.vstack([(dense.astype(np.float64) @ (root @ beta)), mean]).astype(np.float32)


def predict(df: DataFrame, languages: list[str], matrix: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, "und"], dtype=object)
        for batch in C.small_batches(batches, most=4 << 20):
            n = batch.num_rows
            raw, offsets = C.utf8(batch.column(1))
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(n, len(languages)), np.zeros(n)
            if languages:
                for at in range(0, n, 256):
                    to = min(n, at + 256)
                    buckets, counts = sparse_rows(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                    out = product(buckets, counts, matrix[:-1]) / np.sqrt(np.maximum(counts, 1))[:, None] + matrix[-1]
                    soft = np.exp(SHARP * (out - out.max(1, keepdims=True)).astype(np.float64))
                    best[at:to], score[at:to] = out.argmax(1), soft.max(1) / soft.sum(1)
                best[~letter], score[~letter] = len(languages), 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    # the letter test looks for the first letter only
    kept = df.select(F.col(f"`{key}`").alias("doc_id"), F.lower(F.col(f"`{text}`")).alias("text"))
    kept = kept.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Fits on the rows whose fold (crc32 of the key modulo 5) isn't 0 and predicts every row."""
    training = df.where(C.remainder(key, 5) != 0).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{key}`").alias("key"))
    languages, matrix = fit(training)
    found = predict(df, languages, matrix, text, key)
    return found.select("doc_id", (C.remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
