"""Operator 10: SimHash near-duplicates found with BK-trees.

Fingerprints: a text's A-Z are lower-cased, words are runs of bytes other than space and 0x09-0x0D, and
each shingle of ``width`` words (repeats included) is hashed with XXH64, seed 42; bit k of the fingerprint
is 1 if over half of the hashes have it. A text with fewer words is one shingle; one without words has
fingerprint zero.

Links: two distinct fingerprints that differ in at most ``radius`` bits agree on all but ``radius`` of
the blocks that the 64 bits are cut into. So each fingerprint is dealt to one tree for every choice of
agreeing blocks, and each tree holds just the fingerprints that share those blocks. Members of trees
larger than ``TREE`` are dealt anew by more and smaller blocks (``FINER``); what is still larger is cut
into pieces of ``TREE`` members, and every piece is searched for all. The trees of a shard
are built together (children keyed by Hamming distance to the parent) and searched together, following
only edges within ``radius`` of the distance to a node. No tree goes
through the driver, as the total has no bound. Each shard returns a spanning forest of its links, not
the pairs; alternating stars then join them.

Texts by similarity (``similar``): a text is the set of its hashes, and two are linked if their sets have an
exact Jaccard similarity of 4/5 at least, or another asked for. As two such fingerprints may differ in any bits, trees
hold the texts that share a band of min-hashes (``BANDS`` of ``BAND`` each: at a similarity of 0.8 one in 30,000 pairs
shares none), and are searched within ``WIDE`` bits (such pairs are 10 bits apart on average, with a spread of 3).
First each text is compared with that member of its trees which shares bands with the most texts; this joins large groups
without looking at all their pairs. Then trees that still hold several groups are searched for pairs of different groups, at
first for the likeliest of each text and then, as far as groups still differ, for all,
of which those stay whose sketches (``HASHES`` min-hashes, of each 8 bits) agree in no less than the similarity asked for, less
three times its spread. Every link is verified on the whole sets of both texts, so that none is wrong.

Defined cases: a null text counts as empty and is linked with the other texts without words; a null
doc_id gets a fingerprint and its group's component but is nobody's component_id; repeated rows are kept,
each with its result; an empty table gives none; other columns are not looked at. Of a group, ``keep_one`` keeps
one row: that with the smallest doc_id (null comes last) and hash of its text; of rows alike in both, any one.
Rows that share a doc_id but not the text are told apart. Sets and texts are named by 64-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syslumen.llm import _common as C
from syslumen.llm.components import components

C.by_value(__name__)

#: Members of a tree, and searches of one, that a task takes together.
TREE = 4096
#: Numbers of blocks that members of larger trees are dealt by, one after the other.
FINER = (8, 12)
#: Rows that a shard of trees holds, on average.
SHARD = 200_000
#: Members of a tree, on average, up to which fewer and longer trees are taken.
MEMBERS = 512
#: Pairs of search and node that are looked at together.
FRONT = 1 << 19
#: Bands of min-hashes by which similar texts meet, min-hashes of a band, and the radius of the search among them.
BANDS, BAND, WIDE = 20, 4, 20
#: Min-hashes of a sketch; the bands are made of the first.
HASHES = 256
#: Pairs of one text that a task verifies together, on average.
SALT = 1000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, in blocks."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return
    line = b" ".join(words)
    if len(words) <= width:
        yield np.array([xxh64_intdigest(line, 42)], np.uint64)
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    step = 1 << 15
    for at in range(0, len(starts), step):
        yield np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[at : at + step], ends[at : at + step], strict=True)], np.uint64)


def _majority(blocks: Iterable[np.ndarray]) -> int:
    counts, total = np.zeros(64, np.int64), 0
    for hashes in blocks:
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        total += len(hashes)
    return sum(1 << k for k in np.flatnonzero(2 * counts > total).tolist())


def fingerprint(text: bytes, width: int = 3) -> int:
    return _majority(shingle_hashes(text, width))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def _texts(df: DataFrame, text: str, key: str) -> DataFrame:
    """``doc_id``, ``h`` (a hash of the text, as in ``of_list``) and ``text``."""
    own = F.col(f"`{text}`")
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(own).alias("h"), F.coalesce(own.cast("string"), F.lit("")).alias("text"))


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """``doc_id``, ``h`` and ``fp``, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches):
            raw, offsets = C.utf8(batch.column(2))
            made = np.array([fingerprint(raw[a:b].tobytes(), width) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], names=["doc_id", "h", "fp"])

    kept = _texts(df, text, key)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, h bigint, fp bigint")


def min_hashes(own: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A number for each band of min-hashes of a set (none for an empty one), and its sketch."""
    if not len(own):
        return np.zeros(0, np.int64), b""
    least = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 1024):
            np.minimum(least, (own[at : at + 1024, None] * by[None, :]).min(0), out=least)
        odd = np.arange(1, 2 * BAND, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out = (least[: BANDS * BAND].reshape(BANDS, BAND) * odd).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return out.view(np.int64), ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def sketches(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """``doc_id``, ``h``, and of the text's set: ``sid`` (a digest), ``fp``, the numbers of its ``bands`` and its ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        by = np.random.default_rng(10).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in C.small_batches(batches, most=2 << 20):
            raw, offsets = C.utf8(batch.column(2))
            sid, fp, keys, made = [], [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = shingle_set(raw[a:b].tobytes(), width)
                sid.append(xxh64_intdigest(own.tobytes(), 42))
                fp.append(_majority([own]))
                key, sketch = min_hashes(own, by)
                keys.append(key)
                made.append(sketch)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(sid), signed(fp), pa.array(keys, pa.list_(pa.int64())), pa.array(made, pa.binary())], names=["doc_id", "h", "sid", "fp", "bands", "sketch"])

    kept = _texts(df, text, key)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, h bigint, sid bigint, fp bigint, bands array<bigint>, sketch binary")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Of the masks, each over all but ``radius`` of so many blocks of bits, any two fingerprints within the radius agree on one."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def masks(radius: int, count: int) -> list[int]:
    """The bit masks that ``count`` fingerprints are dealt by at first."""
    for blocks in range(radius + 1, radius + 4):
        if count <= MEMBERS << (64 * (blocks - radius) // blocks) or blocks == radius + 3:
            return block_masks(blocks, radius)
    raise AssertionError


class Forest:
    """BK-trees of values, one for each group; built and searched a level at a time."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values = values
        order = np.argsort(groups, kind="stable")
        ids = groups[order]
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        self.ids, self.roots = ids[new], order[new]
        nodes, heads = order, np.flatnonzero(new)
        keys, children = [], []
        while len(nodes):
            first = np.zeros(len(nodes), bool)
            first[heads] = True
            parents = np.repeat(nodes[heads], np.diff(np.append(heads, len(nodes))))[~first]
            nodes = nodes[~first]
            if not len(nodes):
                break
            key = parents * 128 + np.bitwise_count(values[nodes] ^ values[parents]).astype(np.int64)
            by = np.argsort(key, kind="stable")
            nodes, key = nodes[by], key[by]
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            heads = np.flatnonzero(start)
            keys.append(key[heads])
            children.append(nodes[heads])
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, np.int64)
        by = np.argsort(self.keys, kind="stable")
        self.keys, self.children = self.keys[by], self.children[by]

    def links(self, searches: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a search and a node of the same group within the radius, as indices, in blocks; ``visits`` counts the nodes looked at."""
        at = np.minimum(np.searchsorted(self.ids, groups), max(len(self.ids) - 1, 0))
        known = np.flatnonzero(self.ids[at] == groups) if len(self.ids) else np.zeros(0, np.int64)
        root = self.roots[at[known]] if len(known) else known
        waiting = [(known[k : k + FRONT], root[k : k + FRONT]) for k in range(0, len(known), FRONT)]
        self.visits = 0
        while waiting:
            q, n = waiting.pop()
            self.visits += len(q)
            d = np.bitwise_count(searches[q] ^ self.values[n]).astype(np.int64)
            found = d <= radius
            if found.any():
                yield q[found], n[found]
            low = np.searchsorted(self.keys, n * 128 + np.maximum(d - radius, 0))
            count = np.searchsorted(self.keys, n * 128 + d + radius, side="right") - low
            live = count > 0
            q, low, count = q[live], low[live], count[live]
            total = int(count.sum())
            if not total:
                continue
            ends = np.cumsum(count)
            cut = np.append(0, np.searchsorted(ends, np.arange(FRONT, total, FRONT)) + 1)
            cut = np.unique(np.append(cut, len(q)))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                c = count[a:b]
                inner = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                waiting.append((np.repeat(q[a:b], c), self.children[np.repeat(low[a:b], c) + inner]))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a with b; each label is the least index known to be connected."""
    while True:
        x, y = label[a], label[b]
        odd = x != y
        if not odd.any():
            return label
        a, b, x, y = a[odd], b[odd], x[odd], y[odd]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def shard_links(table: pa.Table, radius: int) -> pa.Table:
    """A spanning forest of the links in one shard with columns ``unit``, ``fp``, ``stored`` and ``search``."""
    unit, fp = table.column("unit").to_numpy(), table.column("fp").to_numpy()
    stored, search = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("stored", "search"))
    forest = Forest(fp[stored].view(np.uint64), unit[stored])
    values, which = np.unique(fp, return_inverse=True)
    label = np.arange(len(values))
    for q, n in forest.links(fp[search].view(np.uint64), unit[search], radius):
        label = merge(label, which[search[q]], which[stored[n]])
    tied = np.flatnonzero(label != np.arange(len(values)))
    return pa.table({"a": values[tied], "b": values[label[tied]]})


def shard_pairs(table: pa.Table, radius: int, least: float, every: bool) -> pa.Table:
    """Pairs of texts in different groups within the radius whose sketches agree in ``least`` or more, and how much; columns as above, ``sid``, ``label`` (the group) and ``sketch``.

    Unless every pair is asked for, that of each search that agrees most.
    """
    unit, fp, sid, label = (table.column(c).to_numpy() for c in ("unit", "fp", "sid", "label"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
    stored, search = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("stored", "search"))
    forest = Forest(fp[stored].view(np.uint64), unit[stored])
    found, held = [np.zeros((0, 3), np.int64)], 0

    def settled() -> np.ndarray:
        pairs = np.unique(np.concatenate(found), axis=0)
        if every or not len(pairs):
            return pairs
        pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 0]))]
        return pairs[np.append(pairs[1:, 0] != pairs[:-1, 0], True)]

    for q, n in forest.links(fp[search].view(np.uint64), unit[search], radius):
        x, y = search[q], stored[n]
        new = label[x] != label[y]
        x, y = x[new], y[new]
        for at in range(0, len(x), 1 << 15):
            i, j = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
            agree = np.count_nonzero(sketch[i] == sketch[j], axis=1)
            near = agree >= least * HASHES
            found.append(np.stack([sid[i], sid[j], agree], 1)[near])
            held += int(near.sum())
            if held > 1 << 20:
                found, held = [settled()], 0
    pairs = settled()
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "agree": pairs[:, 2]})


def _units(rows: DataFrame, extra: list[str]) -> DataFrame:
    """What a task takes together: a piece of a tree, and a part of its searches; rows ``tree, members, searches, search`` and others."""
    piece, part = (F.ceil(F.col(c) / F.lit(TREE)).cast("int") for c in ("members", "searches"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("fp", *extra), n).cast("int")
    small = (F.col("members") <= TREE) & (F.col("searches") <= TREE)
    rest = ["tree", "fp", *extra]
    whole = rows.where(small).select(F.xxhash64("tree").alias("unit"), "fp", *extra, F.lit(True).alias("stored"), "search")
    kept = rows.where(~small).select(*rest, own(piece).alias("p"), all_of(part).alias("q")).withColumns({"stored": F.lit(True), "search": F.lit(False)})
    asked = rows.where(~small & F.col("search")).select(*rest, own(part).alias("q"), all_of(piece).alias("p")).withColumns({"stored": F.lit(False), "search": F.lit(True)})
    return whole.union(kept.unionByName(asked).select(F.xxhash64("tree", "p", "q").alias("unit"), "fp", *extra, "stored", "search"))


def _in_shards(units: DataFrame, shards: int):
    return units.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "unit"), F.lit(shards))).groupBy("shard")


def _shards(spark, rows: int) -> int:
    return max(1, -(-rows // SHARD), int(spark.conf.get("spark.sql.shuffle.partitions")) if rows > 50_000 else 1)


def fingerprint_links(fps: DataFrame, radius: int, count: int) -> DataFrame:
    """Links ``(a, b)`` that connect all of the distinct fingerprints ``fp`` within ``radius`` bits of one another."""
    spark, shared = fps.sparkSession, C.Shared(fps.sparkSession)
    left, out = fps.select("fp"), spark.createDataFrame([], "a bigint, b bigint")
    levels = [masks(radius, count), *(block_masks(n, radius) for n in FINER if n > radius + 3)]
    for k, cut in enumerate(levels):
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in cut]
        tree = lambda j, m: F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")))
        rows = left.select("fp", F.explode(F.array(*(tree(j, m) for j, m in enumerate(signed)))).alias("tree"))
        sizes = shared.write(rows.groupBy("tree").agg(F.count("*").alias("members")).where("members > 1"), f"sizes-{k}")
        total, largest = sizes.agg(F.coalesce(F.sum("members"), F.lit(0)), F.max("members")).head()
        last = k + 1 == len(levels)
        now = sizes if last else sizes.where(F.col("members") <= TREE)
        now = now.withColumn("weight", F.col("members"))
        found = hot_rows(rows, now).withColumn("searches", F.col("members")).withColumn("search", F.lit(True))
        out = out.union(shared.write(_in_shards(_units(found, []), _shards(spark, total)).applyInArrow(lambda t: shard_links(t, radius), "a bigint, b bigint"), f"links-{k}"))
        if last or (largest or 0) <= TREE:
            break
        large = sizes.where(F.col("members") > TREE).withColumn("weight", F.col("members"))
        left = shared.write(hot_rows(rows, large).select("fp").distinct(), f"left-{k}")
    return out


def hot_rows(rows: DataFrame, trees: DataFrame) -> DataFrame:
    return C.hot_join(rows, trees, ["tree"], "weight")


def _nodes(own: DataFrame, shared: C.Shared, *more: Column) -> DataFrame:
    """For each ``node``: ``copies`` (rows of ``own`` with it), ``least`` (doc_id) and ``own_first``, its first row's place."""
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")
    return shared.write(own.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(place).alias("own_first"), *more), "nodes")


def _placed(nodes: DataFrame, roots: DataFrame, shared: C.Shared) -> DataFrame:
    """For each ``node``: ``copies``, ``component_id`` (the least doc_id of its group) and ``first``, the place of the group's first row."""
    tied = nodes.select("node", "copies", "least", "own_first").join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    tied = shared.write(tied, "tied")
    groups = shared.write(tied.groupBy("root").agg(F.count("*").alias("size"), F.min("least").alias("component_id"), F.min("own_first").alias("first")), "roots")
    return shared.write(C.hot_join(tied, groups, ["root"], "size").select("node", "copies", "component_id", "first"), "placed")


def _by_fingerprint(df: DataFrame, radius: int, width: int, text: str, key: str, shared: C.Shared) -> tuple[DataFrame, DataFrame]:
    """The documents with their fingerprint as ``node``, and the nodes with their groups."""
    own = shared.write(fingerprints(df, text, key, width).withColumnRenamed("fp", "node"), "fingerprints")
    nodes = _nodes(own, shared)
    return own, _placed(nodes, components(fingerprint_links(nodes.select(F.col("node").alias("fp")), radius, nodes.count()), shared), shared)


def near_duplicates(df: DataFrame, radius: int = 3, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``fp`` (signed) and ``component_id``, the smallest doc_id that links reach."""
    own, placed = _by_fingerprint(df, radius, width, text, key, C.Shared(df.sparkSession))
    return C.hot_join(own.select("doc_id", "node"), placed, ["node"], "copies").select("doc_id", F.col("node").alias("fp"), "component_id")


def _with_text(pairs: DataFrame, texts: DataFrame, side: str, shared: C.Shared, name: str) -> DataFrame:
    """``pairs`` with the text of ``side``. A text of many pairs is dealt out with shares of them."""
    counts = shared.write(pairs.groupBy(side).agg(F.count("*").alias("weight")).withColumn("salts", F.ceil(F.col("weight") / F.lit(SALT)).cast("int")), f"{name}-{side}")
    dealt = C.hot_join(pairs, counts, [side], "weight").withColumn("salt", F.pmod(F.xxhash64(*pairs.columns), F.col("salts")).cast("int"))
    copies = texts.select(F.col("sid").alias(side), F.col("text").alias(f"text_{side}")).join(counts.select(side, "salts"), side)
    copies = copies.select(side, f"text_{side}", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return dealt.drop("salts").join(copies, [side, "salt"]).drop("salt")


def verified(pairs: DataFrame, df: DataFrame, nodes: DataFrame, similarity: float, width: int, text: str, key: str, shared: C.Shared, name: str) -> DataFrame:
    """The pairs ``(a, b)`` of sets that are similar, by whole sets made anew from one text of each."""
    pairs = shared.write(pairs.select("a", "b").distinct(), f"{name}-pairs")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = nodes.join(ids, "node", "left_semi").select("own_first.doc_id", "own_first.h", F.col("node").alias("sid"))
    asked = C.listed(shared, asked, f"{name}-ids")
    rows = _texts(df, text, key).withColumnsRenamed({"doc_id": "d", "h": "g"})
    texts = rows.join(asked, rows["d"].eqNullSafe(asked["doc_id"]) & (rows["g"] == asked["h"])).select("sid", "text")
    texts = shared.write(texts.groupBy("sid").agg(F.min("text").alias("text")), f"{name}-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            a, b, left, right = (batch.column(k) for k in range(4))
            keep = []
            for x, y in zip(left, right, strict=True):
                y = y.as_py().encode()
                if y != last[0]:
                    last = (y, shingle_set(y, width))
                one, two = shingle_set(x.as_py().encode(), width), last[1]
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(two) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = _with_text(_with_text(pairs, texts, "a", shared, name), texts, "b", shared, f"{name}-two").select("a", "b", "text_a", "text_b")
    found = shared.write(both.mapInArrow(run, "a bigint, b bigint"), f"{name}-links")
    shared.drop(f"{name}-texts")
    return found


def _similar(df: DataFrame, similarity: float, width: int, text: str, key: str, shared: C.Shared) -> tuple[DataFrame, DataFrame]:
    """The documents with the digest of their set as ``node``, and the nodes with their groups."""
    own = shared.write(sketches(df, text, key, width).withColumnRenamed("sid", "node"), "sketches")
    nodes = _nodes(own, shared, F.min("sketch").alias("sketch"))
    rows = shared.write(own.select(F.col("node").alias("sid"), "fp", F.explode("bands").alias("tree")).distinct(), "trees")
    trees = shared.write(rows.groupBy("tree").agg(F.count("*").alias("weight")).where("weight > 1"), "sizes")
    total = trees.agg(F.coalesce(F.sum("weight"), F.lit(0))).head()[0]
    # how many texts a text shares bands with: in a group of copies, the original has the most
    members = shared.write(hot_rows(rows, trees.withColumn("size", F.col("weight"))), "members")
    dense = members.groupBy("sid").agg(F.sum("size").alias("dense"))
    members = shared.write(members.select("sid", "fp", "tree", "size").join(dense, "sid"), "dense")
    best = F.max_by("sid", F.struct("dense", "sid"))
    centers = shared.write(members.groupBy("tree").agg(best.alias("center"), F.max("dense").alias("most"), F.count("*").alias("weight")), "centers")
    first = hot_rows(members.select("sid", "tree"), centers).groupBy("sid").agg(F.max_by("center", F.struct("most", "center")).alias("center"))
    pairs = first.where("sid <> center").select(F.greatest("sid", "center").alias("a"), F.least("sid", "center").alias("b"))
    check = lambda pairs, name: verified(pairs, df, nodes, similarity, width, text, key, shared, name)
    roots = components(check(pairs, "first"), shared, "groups")
    least = similarity - 3 * (similarity * (1 - similarity) / HASHES) ** 0.5
    for name in ("best", "others"):
        every = name == "others"
        named = members.join(roots.select(F.col("a").alias("sid"), F.col("b").alias("label")), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        named = shared.write(named.select("sid", "fp", "tree", "dense", "label"), f"{name}-named")
        # in a tree of several groups, that of its center needn't be searched for: all others search it
        mixed = named.groupBy("tree").agg(F.count("*").alias("members"), F.max_by("label", F.struct("dense", "sid")).alias("main"), F.min("label").alias("x"), F.max("label").alias("y"))
        mixed = shared.write(mixed.where("x < y").select("tree", "members", "main", F.col("members").alias("weight")), f"{name}-mixed")
        if not mixed.limit(1).count():
            break
        inside = shared.write(hot_rows(named, mixed).withColumn("search", F.col("label") != F.col("main")), f"{name}-inside")
        asked = inside.where("search").groupBy("tree").agg(F.count("*").alias("searches"), F.max("members").alias("weight"))
        asked = shared.write(asked, f"{name}-asked")
        inside = hot_rows(inside, asked).join(nodes.select(F.col("node").alias("sid"), "sketch"), "sid")
        units = _units(inside.select("tree", "members", "searches", "search", "fp", "sid", "label", "sketch"), ["sid", "label", "sketch"])
        search = (lambda t: shard_pairs(t, WIDE, least, True)) if every else (lambda t: shard_pairs(t, WIDE, least, False))
        more = _in_shards(units, _shards(df.sparkSession, total)).applyInArrow(search, "a bigint, b bigint, agree bigint")
        if not every:
            more = more.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))
        more = more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        roots = components(roots.union(check(more, name)), shared, f"{name}-all")
    return own, _placed(nodes, roots, shared)


def similar(df: DataFrame, similarity: float = 0.8, width: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``sid`` (a digest of the text's set) and ``component_id``, the smallest doc_id that links reach."""
    own, placed = _similar(df, similarity, width, text, key, C.Shared(df.sparkSession))
    return C.hot_join(own.select("doc_id", "node"), placed, ["node"], "copies").select("doc_id", F.col("node").alias("sid"), "component_id")


def keep_one(df: DataFrame, similarity: float | None = 0.8, radius: int = 3, width: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that come first in their group; all columns stay.

    Groups are those of ``similar``, or without a similarity those of ``near_duplicates`` within ``radius`` bits.
    """
    shared = C.Shared(df.sparkSession)
    own, placed = _by_fingerprint(df, radius, width, text, key, shared) if similarity is None else _similar(df, similarity, width, text, key, shared)
    here = C.hot_join(own.select("doc_id", "h", "node"), placed, ["node"], "copies")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    here = shared.write(here.groupBy("doc_id", "h", stays.alias("stays")).agg(F.count("*").alias("rows")), "here")
    left = C.of_list(df, C.listed(shared, here.where("not stays").select("doc_id", "h"), "gone"), key, text, "left_anti")
    twice = here.where("stays and rows > 1").select("doc_id", "h")
    if not twice.limit(1).count():
        return left
    twice = C.listed(shared, twice, "twice")
    (again,) = C.fresh(df, "h_")
    once = C.of_list(left, twice, key, text, "left_semi").withColumn(again, F.xxhash64(F.col(f"`{text}`"))).dropDuplicates([key, again]).drop(again)
    return C.of_list(left, twice, key, text, "left_anti").union(once)


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
