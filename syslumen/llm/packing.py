"""Packing of tokenised documents into sequences of bounded size by vector best-fit.

A document is its token ids and an end id. One of more tokens than a sequence takes is cut into whole sequences from its end,
so that its first piece alone may be shorter. A piece asks for three things at once: tokens, one place of a document, and
attention cost (the square of its length). Pieces go in order of decreasing demand, each into the sequence that bears it under
every capacity and is the tightest: by the least weighted norm of what stays free, or by the least weighted product of demand
and what is free. Those that no sequence bears open one.

A demand follows from a length, so that the decisions are those about a histogram of lengths: at most as many classes as a
sequence has tokens, whatever the number of documents. The driver sees that histogram alone and keeps sequences of equal content
as ranges of numbers. Which piece takes which place is settled by its rank among pieces of its length, which tasks count for
themselves and a prefix sum over their counts makes global; no length, document or source is gathered anywhere.

Defined results: a null text is an empty one, of which the end id is left; null and repeated ids are kept, each row for itself; an
empty table gives no rows; columns beside ``doc_id`` and ``text`` are not looked at. Pieces of one length share the places of that
length by order of task and row.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syslumen.llm import _common as C
from syslumen.llm.bpe import byte_characters

C.by_value(__name__)

#: Weights of tokens, places and attention cost, and the measure: of these the one with the fewest sequences is taken.
CHOICES = (("norm", (1.0, 0.0, 0.0)), ("norm", (1.0, 0.0, 1.0)), ("dot", (1.0, 0.5, 0.5)))

@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most. Places and attention cost that aren't given never bind beyond the tokens."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype="int64")

    def longest(self) -> int:
        """The longest piece that fits an empty sequence."""
        tokens, _, attention = self.limits()
        return int(min(tokens, math.isqrt(int(attention))))


def tokenizer(model: bytes):
    """The tokenizer of a file's bytes; the strings of its special tokens are ordinary text where they occur."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(model.decode())
    made.encode_special_tokens = True
    return made


class Encoder:
    """Ids of texts as bytes of little-endian 32-bit integers, those that ``tokenizer`` gives.

    The merges of the file go by rank if they stand in the order of their ids; then a faster library does the same with ranks. Texts
    that it refuses (a million blanks in a row), and files of another order, are the tokenizer's own.
    """

    def __init__(self, model: bytes, pattern: str):
        import tiktoken

        whole = json.loads(model)
        told, self.model, self.slow = whole["model"], model, None
        byte = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(byte[c] for c in token): k for token, k in told["vocab"].items() if all(c in byte for c in token)}
        merged = [told["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in told["merges"]]
        for extra in whole["added_tokens"]:
            ranks.pop(extra["content"].encode(), None)
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) else None

    def __call__(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:
                pass
        self.slow = self.slow or tokenizer(self.model)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pieces(docs: DataFrame, model: bytes, pattern: str, capacity: Capacity, end_id: int = 0, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (with ``ids`` if they are kept), and ``task, place``: the piece's number among those
    of its length in its task."""
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind, most, end = docs.schema[key].dataType.simpleString(), capacity.longest(), np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = Encoder(model, pattern), TaskContext.get().partitionId()
        seen = np.zeros(most + 1, dtype="int64")
        for batch in C.small_batches(batches):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, body in enumerate(batch.column(1)):
                made = encode(body.as_py() or "") + end
                n = len(made) // 4
                count = -(-n // most)
                at = 0
                for k in range(count):
                    to = n - (count - 1 - k) * most
                    rows.append(row), piece.append(k), start.append(at), length.append(to - at), crc.append(zlib.crc32(made[4 * at : 4 * to]))
                    if keep_ids:
                        ids.append(np.frombuffer(made, dtype="<u4", offset=4 * at, count=to - at).astype("int32"))
                    at = to
            size = np.array(length, dtype="int64")
            # the place of a piece: those of its length before it in the task
            order = np.argsort(size, kind="stable")
            first = np.searchsorted(size[order], size[order], side="left")
            place = np.empty(len(size), dtype="int64")
            place[order] = np.arange(len(size)) - first
            place += seen[size]
            seen += np.bincount(size, minlength=most + 1)
            made = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), task, "int32")), pa.array(place)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
            if keep_ids:
                made.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(made, names=names)

    more = ", ids array<int>" if keep_ids else ""
    return own.mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint{more}")


@dataclass
class Plan:
    """Who goes where, by events: of the pieces of ``length``, those from rank ``rank`` on fill ``each`` places of the sequences from
    ``sequence`` on, the first of them at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of pieces by length and rank."""
        first, last = np.searchsorted(self.length, length, side="left"), np.searchsorted(self.length, length, side="right")
        # within a length the events are in order of rank: halve until each is found
        low, high = first, last - 1
        while (low < high).any():
            middle = (low + high + 1) // 2
            right = self.rank[middle] <= rank
            low, high = np.where(right, middle, low), np.where(right, high, middle - 1)
        within = rank - self.rank[low]
        return self.sequence[low] + within // self.each[low], self.offset[low] + within % self.each[low] * length


def plan(counts: dict[int, int], capacity: Capacity, measure: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> Plan:
    """Best-fit decreasing of a histogram of lengths.

    Sequences of equal content are one range of numbers with what is used of each capacity. A class fills a range with as many
    pieces each as it bears, since after one the same sequence is tighter still; a range of which a part is filled becomes two,
    three at most, so that there are at most three ranges a class.
    """
    limit = capacity.limits()
    w = np.array(weights) / limit.astype(float) ** 2
    start, many, used = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros((0, 3), "int64")
    events, opened = [], 0

    def bears(free: np.ndarray, demand: np.ndarray) -> np.ndarray:
        return (free // demand).min(axis=-1)

    for length in sorted(counts, reverse=True):
        demand, left, rank = np.array([length, 1, length * length], dtype="int64"), int(counts[length]), 0
        if left <= 0:
            continue
        free = limit - used
        fits = np.flatnonzero(bears(free, demand) > 0)
        if measure == "norm":
            score = (w * ((free[fits] - demand) ** 2)).sum(axis=1)
        else:
            score = (w * free[fits] * demand).sum(axis=1)
        fresh: list[tuple[int, int, np.ndarray]] = []
        for g in fits[np.lexsort((start[fits], score))]:
            if not left:
                break
            k = int(bears(limit - used[g], demand))
            whole = min(int(many[g]), left // k)
            # a last sequence takes what is too little for k
            rest = left - whole * k if whole < many[g] and left - whole * k < k else 0
            at, filled = int(start[g]), used[g].copy()
            for n, each in ((whole, k), (1, rest)):
                if n and each:
                    events.append((length, rank, at, each, int(filled[0])))
                    fresh.append((at, n, filled + each * demand))
                    rank, left, at = rank + n * each, left - n * each, at + n
            start[g], many[g] = at, many[g] - (at - start[g])
        if left:
            k = int(bears(limit, demand))
            for n, each in ((left // k, k), (1, left % k)):
                if n and each:
                    events.append((length, rank, opened, each, 0))
                    fresh.append((opened, n, each * demand))
                    rank, opened = rank + n * each, opened + n
        if fresh:
            start = np.append(start, [f[0] for f in fresh])
            many = np.append(many, [f[1] for f in fresh])
            used = np.vstack([used, *(f[2] for f in fresh)])
        # what is full or used up bears nothing more
        live = (many > 0) & ((limit - used) > 0).all(axis=1)
        start, many, used = start[live], many[live], used[live]
    table = np.array(sorted(events), dtype="int64").reshape(-1, 5)
    return Plan(*table.T, sequences=opened)


def fewest(counts: dict[int, int], capacity: Capacity, choices=CHOICES) -> Plan:
    """The plan with the fewest sequences of those by the given measures and weights; the first of equal ones."""
    return min((plan(counts, capacity, *choice) for choice in choices), key=lambda p: p.sequences)


def pack(docs: DataFrame, model: bytes, pattern: str, capacity: Capacity | None = None, end_id: int = 0, key: str = "doc_id", text: str = "text", choices=CHOICES, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece; with ``ids`` if they are kept."""
    capacity, spark = capacity or Capacity(), docs.sparkSession
    shared = C.Shared(spark)
    made = shared.write(pieces(docs, model, pattern, capacity, end_id, key, text, keep_ids), "pieces")
    told = shared.write(made.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    # a class a row: at most as many as a sequence has tokens
    counts = {r["length"]: r["n"] for r in told.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    chosen = fewest(counts, capacity, choices)
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = told.select("length", "task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = made.join(before, ["length", "task"]).select(*names, (F.col("place") + F.col("before")).alias("rank"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names
            sequence, offset = chosen.places(batch.column(at.index("length")).to_numpy(), batch.column(at.index("rank")).to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.select(*names).schema)
    return ranked.mapInArrow(settle, f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the token ids of each sequence and the documents in it, from pieces that kept their ids."""
    made = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return made.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
