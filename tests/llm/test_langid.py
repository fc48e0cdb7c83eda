import random

import numpy as np
import pytest
from helpers import awkward, empty

from pyspark.sql import functions as F

from syslumen.llm import _common as C
from syslumen.llm import langid as G

ALPHABETS = {"aa": "abcd", "bb": "befg", "cc": "hijé"}


def texts(n, seed=1):
    rng = random.Random(seed)
    make = lambda lang: " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(4, 30)))
    return [(k, make(lang), lang) for k in range(n) for lang in [rng.choice(["aa", "aa", "aa", "bb", "cc"])]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(500), "doc_id bigint, text string, lang string")


def grams(text):
    raw = text.encode()
    return {raw[i : i + n] for n in range(1, G.LONGEST + 1) for i in range(len(raw) - n + 1)}


def test_presence_counts_distinct_grams():
    for _, text, _ in texts(40):
        flags = np.zeros(G.BUCKETS, np.uint8)
        G.present(np.frombuffer(text.encode(), np.uint8), flags)
        # buckets may coincide, rarely
        assert len(grams(text)) - 3 <= flags.sum() <= len(grams(text))


def test_long_texts_are_the_same_in_chunks(monkeypatch):
    raw = np.frombuffer("".join(t for _, t, _ in texts(50)).encode(), np.uint8)
    a, b = np.zeros(G.BUCKETS, np.uint8), np.zeros(G.BUCKETS, np.uint8)
    G.present(raw, a)
    monkeypatch.setattr(G, "CHUNK", 37)
    G.present(raw, b)
    assert np.array_equal(a, b)


def test_folded_matrix_equals_the_kernel_machine(docs):
    """Scores by the folded matrix equal those from kernels with the landmarks themselves."""
    rows, counts = G.sparse_rows(np.frombuffer(b"abcabd", np.uint8), np.array([0, 3, 6]))
    dense = np.random.default_rng(1).normal(size=(G.BUCKETS, 3)).astype(np.float32)
    whole = np.zeros((2, G.BUCKETS), np.float32)
    whole[np.repeat([0, 1], counts), rows] = 1
    assert np.allclose(G.product(rows, counts, dense), whole @ dense, atol=1e-4)


def test_held_out_accuracy(docs):
    found = G.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 50 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    assert all(0 < r["score"] <= 1 for r in found)


def test_awkward_rows(spark, docs):
    mixed = awkward(spark).unionByName(docs.selectExpr("doc_id + 100 as doc_id", "text", "lang"), allowMissingColumns=True)
    by = {r["doc_id"]: r for r in G.identify(mixed).where("doc_id < 100").collect()}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1, 2, 3))
    assert by[4]["lang_pred"] != "und"
    assert all(r["lang_pred"] == "und" for r in G.identify(awkward(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect())
    assert G.identify(empty(spark)).count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    rows = []
    for lang in range(300):
        letters = [chr(rng.randrange(0x400, 0x2000)) for _ in range(6)]
        rows += [(0, "".join(rng.choice(letters) for _ in range(60)), f"l{lang}") for _ in range(8 if lang else 2000)]
    docs = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string")
    found = G.identify(docs).join(docs, "doc_id")
    assert found.select("lang_pred").distinct().count() >= 290
    assert found.where("lang = lang_pred").count() >= 0.9 * len(rows)


def test_held_out_labels_change_nothing(spark, docs):
    other = docs.withColumn("lang", F.when(C.remainder("doc_id", 5) == 0, "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, G.identify(d).collect())) for d in (docs, other))
    assert a == b
