import random
import re

import pytest
from helpers import awkward, empty

import corpus_pipeline as cp
from syslumen.llm import simhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(texts):
    """Least index that links reach, by comparing all pairs."""
    own, label = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if similar(own[i], own[j]) or own[i] == own[j]:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(own))]


@pytest.mark.parametrize("tree", [4096, 8])
def test_all_pairs_are_found(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(15))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(250))) for _ in range(60)]
    texts += [f"{t} {passage}" for t in texts[:30]]
    for _ in range(160):
        own = rng.choice(texts).split()
        for _ in range(rng.randrange(6)):
            if own:
                own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own[: len(own) - rng.randrange(4)]).upper())
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)


def test_stage_drops_a_pair_that_simhash_keeps(spark):
    rng = random.Random(5)
    a = [f"w{rng.randrange(10_000)}" for _ in range(248)]
    b = list(a)
    for k in (40, 90, 140, 190):
        b[k] = "other"
    texts = [" ".join(a), " ".join(b)]
    assert similar(*map(shingles, texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert simhash.keep_one(docs, similarity=None, width=3).count() == 2
    assert [r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, "").collect()] == [0]


def test_awkward_rows(spark):
    kept = simhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 4, 5, 6, None]
    assert simhash.keep_one(empty(spark)).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    one, other = "the same words in both of these rows", "an unrelated text that nobody else has"
    rows = [(1, one, 0), (2, one, 1), (2, other, 2), (1, one, 3), (None, one, 4), (None, "alone without an id", 5), (None, "alone without an id", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h_ int")
    for similarity in (0.8, None):
        kept = simhash.keep_one(docs, similarity=similarity)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "alone without an id"), (1, one), (2, other)]


def test_a_large_group_is_one_star(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for k in range(3000):
        own = list(base)
        own[rng.randrange(len(own))] = f"x{k}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r["doc_id"] for r in simhash.keep_one(docs).collect()] == [0]
