"""Vector best-fit against plain best-fit piece by piece, and every promise about the pieces."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import helpers
import numpy as np
import public_tokenizers
import pytest

from syslumen.llm import packing

MODEL = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()


def pack(docs, **more):
    return packing.pack(docs, MODEL, public_tokenizers.PATTERN, **more)


def plain(lengths, capacity, measure, weights):
    """Best-fit decreasing, one piece after the other: the number of sequences."""
    limit = capacity.limits()
    w = np.array(weights) / limit.astype(float) ** 2
    free = []
    for n in sorted(lengths, reverse=True):
        demand = np.array([n, 1, n * n])
        fits = [k for k, f in enumerate(free) if (f >= demand).all()]
        score = (lambda f: (w * (f - demand) ** 2).sum()) if measure == "norm" else (lambda f: (w * f * demand).sum())
        if fits:
            best = min(fits, key=lambda k: (score(free[k]), k))
            free[best] = free[best] - demand
        else:
            free.append(limit - demand)
    return len(free)


@pytest.mark.parametrize("capacity", [packing.Capacity(100), packing.Capacity(100, documents=4), packing.Capacity(100, attention=5000), packing.Capacity(100, 3, 4000)])
@pytest.mark.parametrize("choice", packing.CHOICES)
def test_ranges_decide_as_single_pieces_do(capacity, choice):
    rng = random.Random(7)
    for most in (9, 60, capacity.longest()):
        lengths = [rng.randint(1, most) for _ in range(300)] + [most // 2] * 40
        counts = Counter(lengths)
        made = packing.plan(counts, capacity, *choice)
        assert made.sequences == plain(lengths, capacity, *choice)
        # every rank has a place, and no sequence holds more than it may
        inside = defaultdict(list)
        for n, k in counts.items():
            sequence, offset = made.places(np.full(k, n), np.arange(k))
            for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
                inside[s].append((o, n))
        assert set(inside) == set(range(made.sequences))
        for held in inside.values():
            at = 0
            for o, n in sorted(held):
                assert o == at
                at += n
            assert (np.array([at, len(held), sum(n * n for _, n in held)]) <= capacity.limits()).all()


def test_few_sequences_of_many_copies():
    made = packing.fewest({700: 10**9, 600: 10**9, 40: 10**6}, packing.Capacity())
    assert len(made.length) < 20
    assert made.sequences <= 1.1 * (1300 * 10**9) / 2048


def test_texts_are_packed_whole(spark):
    tokenizer = packing.tokenizer(MODEL)
    rng = random.Random(3)
    words = ["pack", " these", " words,", "\n\n", " naïve", " 12345", "<|endoftext|>", " 日本語", "'s"]
    texts = ["".join(rng.choices(words, k=rng.randint(0, 900))) for _ in range(120)] + ["x " * 9000, "", None, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    capacity = packing.Capacity(512)
    rows = pack(docs, capacity=capacity, keep_ids=True).collect()
    by_doc, inside = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, text in enumerate(texts):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [i for r in own for i in r["ids"]] == want
        assert [r["length"] for r in own[1:]] == [512] * (len(own) - 1) and len(own) == -(-len(want) // 512)
        for r in own:
            assert r["start"] == sum(x["length"] for x in own[: r["piece"]])
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for held in inside.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 512
    assert len(inside) == plain([n for held in inside.values() for _, n in held], capacity, *packing.CHOICES[0])


def test_sequences_hold_their_pieces(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (3, None)], "doc_id long, text string")
    packed = pack(docs, keep_ids=True)
    rows = packing.sequences(packed).collect()
    assert len(rows) == 1 and sorted(rows[0]["doc_ids"]) == [1, 2, 3]
    assert len(rows[0]["ids"]) == sum(r["length"] for r in packed.collect()) and rows[0]["ids"].count(0) == 3


def test_ids_are_the_tokenizers(spark):
    encode, tokenizer = packing.Encoder(MODEL, public_tokenizers.PATTERN), packing.tokenizer(MODEL)
    assert encode.fast is not None
    rng = random.Random(5)
    signs = " \n\t\r\x0b\x0c\x1c\x85\xa0 　'stveASTx9éßЖ漢😀.,#_-́​\xad²½"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 20))) for _ in range(3000)] + [" " * 1_000_000 + "x", "a<|endoftext|>b", "z" * 50_000]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_awkward_rows(spark):
    rows = pack(helpers.awkward(spark)).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter([1, 2, 3, 4, 5, 5, None, 6])
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert pack(helpers.empty(spark)).collect() == []
