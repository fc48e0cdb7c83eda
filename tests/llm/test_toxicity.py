import random

import numpy as np
import pytest
from helpers import awkward, empty

from syslumen.llm import toxicity as T


def sample(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rows = []
    for k in range(n):
        words, toxic = [word() for _ in range(rng.randrange(5, 120))], k % 3 == 0
        if toxic:
            # known words, and new ones with a known beginning
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "vile", "quozz" + word()])
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_gradients_equal_differences():
    texts = [b"idiot is a test word here", "bon jour é clown".encode(), b""]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    hashes, spans, counts, letters = T.words(raw, offsets)
    assert counts.tolist() == [6, 4, 0]
    vocabularies = [np.unique(h[:4]) for h in hashes]
    net = T.Network(vocabularies, [np.zeros(len(v), np.float32) for v in vocabularies])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    start, length, _ = T.windows(counts)
    steps = np.arange(6)[:, None]
    mask, index = steps < length, np.minimum(start + steps, len(hashes[0]) - 1).reshape(-1)
    ids, y = net.ids(hashes)[:, index], np.array([1.0, 0, 1])
    own, chars = T._gathered(spans, letters, index)

    def loss():
        x = net.inputs(ids, own, chars).T.astype(float).reshape(T._IN, 6, 3)
        states = {d: net.layer([net.p[f"w{d}"] @ x[:, k] + net.p[f"b{d}"] for k in range(6)], mask, d, None) for d in "fb"}
        logit = net.pooled(states["f"], states["b"], mask)[0]
        return (np.log1p(np.exp(logit)) - y * logit).sum()

    found = net.gradients(ids, own, chars, mask, y, np.ones(3))
    for name, value in net.p.items():
        at = np.unravel_index(np.abs(found[name]).argmax(), value.shape)
        was, step = value[at], 1e-4
        value[at] = was + step
        up = loss()
        value[at] = was - step
        down = loss()
        value[at] = was
        assert found[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6), name


def test_windows_cover_every_word():
    counts = np.array([0, 1, 32, 33, 57, 500])
    start, length, text = T.windows(counts)
    for k, n in enumerate(counts):
        own = text == k
        base = counts[:k].sum()
        covered = {i for s, m in zip(start[own] - base, length[own], strict=True) for i in range(s, s + m)}
        assert covered == set(range(n)) and own.sum() >= 1
        assert all(b - a == T.STRIDE for a, b in zip(start[own], start[own][1:], strict=False))


def test_scores_dont_depend_on_the_batch():
    rows = sample(60)
    net = T.train([t.encode() for _, t, _ in rows], np.array([float(y) for *_, y in rows]), 1 / 3)
    raw = [t.encode() for _, t, _ in rows]
    together = net.texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    alone = [net.texts(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in raw]
    assert np.allclose(together, alone, atol=1e-4)


def test_held_out_accuracy(spark):
    rows = sample(900)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    found = T.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 100 and sum(r["predicted"] == r["toxic"] for r in found) >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(k, int(k in (4, 5))) for k in (1, 2, 3, 4, 5, 6)] + [(1, None)], "doc_id bigint, toxic int")
    rows = T.classify(awkward(spark), labels).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    none = T.classify(awkward(spark), labels.limit(0)).collect()
    assert all(r["score"] == 0 for r in none)
    assert T.classify(empty(spark), labels).count() == 0
