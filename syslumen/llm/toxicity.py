"""Operator 6: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Words are runs of letter bytes of the lower-cased text. A word's input is its own vector, where the vocabulary
has it, beside a character vector: the mean of its bytes' vectors plus those of its beginnings of
``BEGINNINGS`` bytes, where known. A text is cut into windows of ``WINDOW`` words that
start every ``STRIDE`` words; each passes through a recurrent layer in either direction, the states are
pooled by attention, and a text's raw score is its highest window's. Two more parameters turn that into
a probability.

Training takes a bounded sample of labelled rows, at most about ``TRAIN`` with label 1
and ``TRAIN_CLEAN`` with label 0, none longer than ``TRAIN_BYTES``, and is multiple-instance: a text is learned from through the window that scores
highest at the time, at first the one whose words have the highest log-odds. All texts and all of their
windows are scored.

Defined cases: a null text counts as empty; a text without words is one window without words, which the
output's bias scores; repeated label rows for a document count once (the greatest label); null labels
aren't learned from; with no label of either class every score is the share of label 1 (0 without any
label); repeated rows are scored alike; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syslumen.llm import _common as C

C.by_value(__name__)

WINDOW, STRIDE = 32, 24
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
#: Words, and beginnings of each length, that have vectors: those in the most rows of the sample.
VOCABULARY = 20_000
BEGINNINGS = (3, 4, 5, 6)
#: What is added to counts before log-odds are taken, so that rare words don't count much.
SMOOTH = 2.0
#: Bounds of the sample that is fitted on: rows with label 1 and with label 0, characters of a row; of longer texts, so many stretches from all over.
TRAIN, TRAIN_CLEAN = 1500, 3000
TRAIN_CHARS, STRETCHES = 1 << 15, 16
ROUNDS, EPOCHS, BATCH, RATE, DECAY = 4, 3, 64, 0.02, 1e-3
#: Shares of words and of beginnings that are hidden while training.
HIDE_WORDS, HIDE_STARTS = 0.5, 0.2
#: Windows that pass through the network together when scoring.
TOGETHER = 2048

_IN = WORD_DIM + CHAR_DIM


def _letters() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    letter = np.zeros(256, bool)
    letter[0x41:0x5B] = letter[0x61:0x7B] = letter[0x80:] = True
    return lower, letter


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: 64-bit hashes (of the word, then of its beginnings; 0 if it is shorter), first and last letter among ``letters``, words of each text; and the letters."""
    lower, letter = _letters()
    inside = letter[raw]
    size = np.diff(offsets)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[:-1][size > 0]] = True
    start = inside.copy()
    if len(raw):
        start[1:] &= ~inside[:-1] | edge[1:-1]
    at = np.flatnonzero(inside)
    first = np.flatnonzero(start[at])
    letters = lower[raw[at]]
    last = np.append(first[1:], len(at))[: len(first)]
    place = np.minimum(np.arange(len(at)) - np.repeat(first, last - first), 255)
    rng = np.random.default_rng(11)
    turn, mark = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1), rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    value = np.add.reduceat(mark[letters] * turn[place], first) if len(first) else np.zeros(0, np.uint64)
    hashes = [value]
    so_far, top = np.zeros(len(first), np.uint64), max(len(letters) - 1, 0)
    for n in range(max(BEGINNINGS)):
        if len(first):
            so_far = so_far + mark[letters[np.minimum(first + n, top)]] * turn[n]
        if n + 1 in BEGINNINGS:
            hashes.append(np.where(last - first > n, so_far, np.uint64(0)))
    owner = np.searchsorted(offsets, at[first], side="right") - 1
    return np.stack([h ^ (h >> np.uint64(31)) for h in hashes]), np.stack([first, last]), np.bincount(owner, minlength=len(size)), letters


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of texts with so many words: first word, number of words, text."""
    each = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(counts)), each)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    start = (np.cumsum(counts) - counts)[text] + inner * STRIDE
    return start, np.clip(counts[text] - inner * STRIDE, 0, WINDOW), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward and backward pass. Arrays are (time, features, windows)."""

    def __init__(self, vocabulary: list[np.ndarray], odds: list[np.ndarray], seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(size=shape).astype(np.float32) / np.float32(np.sqrt(shape[-1]))
        self.vocabulary = vocabulary
        self.p = {"word": 0.1 * small(len(vocabulary[0]) + 1, WORD_DIM), "char": 0.5 * small(256, CHAR_DIM), "attend": small(ATTEND, 2 * HIDDEN), "attend_b": np.zeros((ATTEND, 1), np.float32), "pick": small(1, ATTEND), "out": small(1, 2 * HIDDEN), "out_b": np.zeros((1, 1), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": small(3 * HIDDEN, _IN), f"b{d}": np.zeros((3 * HIDDEN, 1), np.float32), f"u{d}": small(3 * HIDDEN, HIDDEN)}
        for n, v in zip(BEGINNINGS, vocabulary[1:], strict=True):
            self.p[f"start{n}"] = 0.05 * small(len(v) + 1, CHAR_DIM)
        for name, own in zip(self.tables, odds, strict=True):
            self.p[name][:-1, 0] = own
        self.platt = (1.0, 0.0)

    @property
    def tables(self) -> list[str]:
        return ["word", *(f"start{n}" for n in BEGINNINGS)]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabularies, a row for each; the last place stands for all that isn't in one."""
        out = np.empty(hashes.shape, np.int64)
        for k, v in enumerate(self.vocabulary):
            at = np.minimum(np.searchsorted(v, hashes[k]), len(v) - 1) if len(v) else None
            out[k] = np.where(v[at] == hashes[k], at, len(v)) if len(v) else 0
        return out

    def inputs(self, ids: np.ndarray, spans: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """(words, word and character vector)"""
        if not ids.shape[1]:
            return np.zeros((0, _IN), np.float32)
        chars = np.add.reduceat(self.p["char"][letters], spans[0], axis=0) / (spans[1] - spans[0])[:, None].astype(np.float32)
        for name, own in zip(self.tables[1:], ids[1:], strict=True):
            chars += self.p[name][own]
        return np.concatenate([self.p["word"][ids[0]], chars], axis=1)

    def layer(self, pre: list[np.ndarray], mask: np.ndarray, d: str, keep: list | None) -> list[np.ndarray]:
        """States at each time, of the layer that reads forwards (f) or backwards (b); pre: what the inputs give to the gates."""
        u, h, out = self.p[f"u{d}"], np.zeros((HIDDEN, mask.shape[1]), np.float32), [None] * len(pre)
        for t in range(len(pre)) if d == "f" else reversed(range(len(pre))):
            g = u @ h
            zr = 1 / (1 + np.exp(-(pre[t][: 2 * HIDDEN] + g[: 2 * HIDDEN])))
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            n = np.tanh(pre[t][2 * HIDDEN :] + r * g[2 * HIDDEN :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, z, r, n, g[2 * HIDDEN :]))
            h = np.where(mask[t], new, h)
            out[t] = h
        return out

    def pooled(self, f: list[np.ndarray], b: list[np.ndarray], mask: np.ndarray) -> tuple[np.ndarray, ...]:
        states = np.concatenate([np.stack(f), np.stack(b)], axis=1)
        t, _, m = states.shape
        flat = np.ascontiguousarray(states.transpose(1, 0, 2)).reshape(2 * HIDDEN, t * m)
        key = np.tanh(self.p["attend"] @ flat + self.p["attend_b"])
        score = np.where(mask, (self.p["pick"] @ key).reshape(t, m), np.float32(-30))
        weight = np.exp(score - score.max(0))
        weight *= mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        context = (flat.reshape(2 * HIDDEN, t, m) * weight).sum(1)
        return (self.p["out"] @ context + self.p["out_b"])[0], flat, key, weight, context

    def raw(self, ids: np.ndarray, spans: np.ndarray, letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The raw scores of windows that stand in the order of their words, a block at a time."""
        out, steps = np.empty(len(start), np.float32), np.arange(WINDOW)[:, None]
        for at in range(0, len(start), TOGETHER):
            s, n = start[at : at + TOGETHER], length[at : at + TOGETHER]
            low, high = int(s.min()), int((s + n).max())
            if low < high:
                own = spans[:, low:high]
                x = self.inputs(ids[:, low:high], own - own[0, 0], letters[own[0, 0] : own[1, -1]])
            else:
                x = np.zeros((1, _IN), np.float32)
            pre = {d: np.ascontiguousarray((x @ self.p[f"w{d}"].T + self.p[f"b{d}"].T).T) for d in "fb"}
            longest = max(1, int(n.max()))
            mask = steps[:longest] < n
            index = np.minimum(s - low + steps[:longest], len(x) - 1)
            f, b = (self.layer([np.take(pre[d], i, axis=1) for i in index], mask, d, None) for d in "fb")
            out[at : at + TOGETHER] = self.pooled(f, b, mask)[0]
        return out

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts' raw scores."""
        hashes, spans, counts, letters = words(raw, offsets)
        start, length, text = windows(counts)
        if not len(text):
            return np.zeros(0, np.float32)
        score = self.raw(self.ids(hashes), spans, letters, start, length)
        return np.maximum.reduceat(score, np.flatnonzero(np.append(True, text[1:] != text[:-1])))

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid(self.platt[0] * raw.astype(np.float64) + self.platt[1])

    def gradients(self, ids: np.ndarray, spans: np.ndarray, letters: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss of windows whose words come time after time, window after window."""
        t, m = mask.shape
        p = self.p
        x = np.ascontiguousarray(self.inputs(ids, spans, letters).T).reshape(_IN, t, m)
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self.layer([p[f"w{d}"] @ x[:, k] + p[f"b{d}"] for k in range(t)], mask, d, kept[d]) for d in "fb"}
        logit, flat, key, attention, context = self.pooled(states["f"], states["b"], mask)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((sigmoid(logit) - y) * weight).astype(np.float32)[None]
        g["out"], g["out_b"] = dl @ context.T, dl.sum(1, keepdims=True)
        dc = p["out"].T @ dl
        cube = flat.reshape(2 * HIDDEN, t, m)
        da = (cube * dc[:, None]).sum(0)
        ds = (attention * (da - (attention * da).sum(0))).reshape(1, t * m)
        g["pick"] = ds @ key.T
        dk = (p["pick"].T @ ds) * (1 - key**2)
        g["attend"], g["attend_b"] = dk @ flat.T, dk.sum(1, keepdims=True)
        dh = (attention[None] * dc[:, None] + (p["attend"].T @ dk).reshape(2 * HIDDEN, t, m)).transpose(1, 0, 2)
        dx = np.zeros_like(x)
        for d, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            back = np.zeros((HIDDEN, m), np.float32)
            for k, h, z, r, n, c in reversed(kept[d]):
                total = dh[k, half] + back
                here = np.where(mask[k], total, 0)
                dn = here * (1 - z) * (1 - n**2)
                gates = np.concatenate([here * (h - n) * z * (1 - z), dn * c * r * (1 - r), dn])
                inner = np.concatenate([gates[: 2 * HIDDEN], dn * r])
                g[f"w{d}"] += gates @ x[:, k].T
                g[f"b{d}"] += gates.sum(1, keepdims=True)
                g[f"u{d}"] += inner @ h.T
                dx[:, k] += p[f"w{d}"].T @ gates
                back = np.where(mask[k], here * z, total) + p[f"u{d}"].T @ inner
        dx = dx.reshape(_IN, t * m).T * mask.reshape(-1, 1)
        for name, own in zip(self.tables, ids, strict=True):
            np.add.at(g[name], own, dx[:, :WORD_DIM] if name == "word" else dx[:, WORD_DIM:])
        size = spans[1] - spans[0]
        np.add.at(g["char"], letters, np.repeat(dx[:, WORD_DIM:] / size[:, None], size, axis=0))
        return g


def _gathered(spans: np.ndarray, letters: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans and letters of some of the words."""
    size = (spans[1] - spans[0])[index]
    end = np.cumsum(size)
    return np.stack([end - size, end]), letters[np.repeat(spans[0][index] - (end - size), size) + np.arange(int(size.sum()))]


def train(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 3) -> Network:
    """A network for texts with labels 0 and 1; share: that of label 1 among all labelled rows."""
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    hashes, spans, counts, letters = words(raw, offsets)
    owner = np.repeat(np.arange(len(texts)), counts)
    some = labels.sum()
    vocabularies, odds = [], []
    for own in hashes:
        value, code = np.unique(own, return_inverse=True)
        pairs = np.unique(owner * max(len(value), 1) + code)
        of, which = pairs // max(len(value), 1), pairs % max(len(value), 1)
        often = np.bincount(which, minlength=len(value))
        toxic = np.bincount(which[labels[of] == 1], minlength=len(value))
        kept = np.sort(np.lexsort((value, -often))[:VOCABULARY])
        kept = kept[(often[kept] >= 3) & (value[kept] != 0)]
        vocabularies.append(value[kept])
        ratio = np.log((toxic + SMOOTH) / (some + 2 * SMOOTH)) - np.log((often - toxic + SMOOTH) / (len(texts) - some + 2 * SMOOTH))
        odds.append(np.clip(ratio[kept], -5, 5).astype(np.float32) / 5)
    net = Network(vocabularies, odds)
    start, length, text = windows(counts)
    ids = net.ids(hashes)
    rough = np.append(np.max([np.append(o, 0)[i] for o, i in zip(odds, ids, strict=True)], axis=0), 0) if len(owner) else np.zeros(1)
    steps = np.arange(WINDOW)
    score = np.max(np.where(steps < length[:, None], rough[np.minimum(start[:, None] + steps, len(rough) - 1)], -9), axis=1)
    rng = np.random.default_rng(seed)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    weight, step = np.where(labels == 1, len(labels) / (2 * max(some, 1)), len(labels) / (2 * max(len(labels) - some, 1))), 0
    clean = np.flatnonzero(labels[text] == 0)
    unknown = np.array([len(v) for v in vocabularies])[:, None]
    bound = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    for _ in range(ROUNDS):
        order = np.lexsort((-score, text))
        top = order[np.searchsorted(text[order], np.arange(len(texts)))]
        for _ in range(EPOCHS):
            # a clean text is clean in every window, so that others than the highest are learned from too
            own = np.concatenate([top, rng.choice(clean, min(len(clean), len(texts) // 2), replace=False)])
            rng.shuffle(own)
            for at in range(0, len(own), BATCH):
                w = own[at : at + BATCH]
                longest = max(1, int(length[w].max()))
                mask = steps[:longest, None] < length[w]
                index = np.minimum(start[w] + steps[:longest, None], max(len(owner) - 1, 0)).reshape(-1)
                if not len(owner):
                    continue
                # some words and beginnings are hidden, so that each is learned from by itself
                own_ids = ids[:, index]
                own_ids = np.where(rng.random(own_ids.shape) < np.array([HIDE_WORDS, *[HIDE_STARTS] * len(BEGINNINGS)])[:, None], unknown, own_ids)
                grads = net.gradients(own_ids, *_gathered(spans, letters, index), mask, labels[text[w]], weight[text[w]] / len(w))
                step += 1
                for k, g in grads.items():
                    m, v = moment[k]
                    if k in net.tables:
                        net.p[k] *= np.float32(1 - DECAY)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.p[k] -= (RATE / (1 + step / 300) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        score = net.raw(ids, spans, letters, start, length)
    best = np.maximum.reduceat(score, bound).astype(np.float64)
    net.platt = _platt(best, labels, np.where(labels == 1, share * len(labels) / max(some, 1), (1 - share) * len(labels) / max(len(labels) - some, 1)))
    return net


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a weighted logistic fit, slightly regularised."""
    theta, z = np.array([1.0, 0.0]), np.column_stack([x, np.ones(len(x))])
    for _ in range(30):
        p = sigmoid(z @ theta)
        grad = z.T @ (weight * (p - y)) + np.array([0.1, 0.0]) * (theta - np.array([1.0, 0.0]))
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag([0.1, 1e-6])
        theta = theta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return (float(max(theta[0], 1e-3)), float(theta[1]))


def fit(df: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id") -> Network | float:
    """The network that these labels give, or the share of label 1 where there's none of either class."""
    one = labels.where(f"{label} is not null").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = {int(r["y"] == 1): r["n"] for r in one.groupBy((F.col("y") == 1).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) < 2:
        return share
    fold = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 24)) / F.lit(float(1 << 24))
    cut = F.when(F.col("y") == 1, F.lit(TRAIN / sizes[1])).otherwise(F.lit(TRAIN_CLEAN / sizes[0]))
    picked = one.where(fold < cut)
    own, each = F.lower(F.col(f"`{text}`")), TRAIN_CHARS // STRETCHES
    at = lambda k: (F.floor(k * (F.length(own) - each) / (STRETCHES - 1)) + 1).cast("int")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.substr(own, at(k), F.lit(each))), " ")
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), F.when(F.length(own) > TRAIN_CHARS, spread).otherwise(own).cast("binary").alias("text")).where("text is not null")
    # the sample has about TRAIN + TRAIN_CLEAN rows of two numbers
    # a doc_id that many rows share gives one
    picked = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = sorted(picked.collect(), key=lambda r: (r["doc_id"], r["text"]))
    if len({r["y"] for r in rows}) < 2:
        return share
    return train([bytes(r["text"]) for r in rows], np.array([float(r["y"] == 1) for r in rows]), share)


def predict(df: DataFrame, model: Network | float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``score`` and ``predicted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.small_batches(batches, most=1 << 20):
            raw, offsets = C.utf8(batch.column(1))
            made = np.full(batch.num_rows, model) if isinstance(model, float) else model.probability(model.texts(raw, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), pa.array((made >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kept = df.select(F.col(f"`{key}`").alias("doc_id"), F.lower(F.col(f"`{text}`")).alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def classify(df: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fits on labelled rows whose fold (crc32 of the key modulo 5) isn't 0 and scores every row."""
    learn = labels.where(C.remainder("doc_id", 5) != 0).select("doc_id", F.col(label).alias("label"))
    found = predict(df, fit(df, learn, "label", text, key), text, key)
    return found.select("doc_id", (C.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
