import random

import numpy as np
from helpers import awkward, empty

from syslumen.llm import quality as Q


def plain_statistics(text):
    """Some of the statistics, word by word."""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(len(words), 1)
    return {"words": len(words), "distinct": len(set(words)) / n, "most": max(map(words.count, set(words)), default=0) / n, "lines": len(lines), "distinct_lines": len(set(lines)) / max(len(lines), 1)}


def test_statistics_equal_plain_counts_and_dont_depend_on_the_batch():
    rng = random.Random(1)
    texts = ["", "\n\n", "a", "a a a b\nx y\nx y", "é!! É$$ 日本"] + ["".join(rng.choice("abc AB.1\n$") for _ in range(rng.randrange(200))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    together = Q.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    names = {"words": 12, "distinct": 18, "most": 19, "lines": 13, "distinct_lines": 21}
    for text, own, row in zip(texts, raw, together, strict=True):
        alone = Q.statistics(np.frombuffer(own, np.uint8), np.array([0, len(own)]))
        assert np.array_equal(alone[0], row)
        want = plain_statistics(text)
        got = {k: row[i] for k, i in names.items()}
        want |= {k: np.log1p(want[k]) for k in ("words", "lines")}
        assert all(abs(got[k] - want[k]) < 1e-5 for k in names), (text, got, want)


def test_isotonic_is_the_best_rising_fit():
    at, to = Q.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.1, 0.5, 0.3, 0.9]), np.array([1.0, 1, 1, 2]))
    assert np.allclose(to, [0.1, 0.4, 0.9]) and np.allclose(at, [0, 1.5, 3])


def labelled(spark, n=400):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 8))) for _ in range(60)) + "."
    bad = lambda: " ".join([rng.choice(["zz", "qq"])] * 70) + "$$$"
    rows = [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(n)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    found = Q.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 50 and sum(r["predicted"] == r["quality"] for r in found) >= 0.98 * len(found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_labels_of_the_held_out_fold_dont_matter(spark):
    from syslumen.llm import _common as C

    docs, labels = labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1 then 1 - quality else quality end as quality")
    assert labels.where(C.remainder("doc_id", 3) == 1).count() > 0
    by = lambda lab: sorted((r["doc_id"], round(r["score"], 9)) for r in Q.classify(docs, lab).collect())
    assert by(labels) == by(flipped)


def test_awkward_rows_and_missing_labels(spark):
    labels = spark.createDataFrame([(1, None), (99, 1)], "doc_id bigint, quality int")
    rows = Q.classify(awkward(spark), labels).collect()
    assert len(rows) == 8 and all(r["score"] == 0.5 for r in rows)
    _, some = labelled(spark, 60)
    docs, _ = labelled(spark, 60)
    assert Q.classify(empty(spark), some).count() == 0
    mixed = awkward(spark).where("doc_id is null or doc_id > 3").unionByName(docs.selectExpr("doc_id + 100 as doc_id", "text"), allowMissingColumns=True)
    shifted = some.selectExpr("doc_id + 100 as doc_id", "quality")
    kept = Q.keep_good(mixed, shifted)
    good = Q.classify(mixed, shifted).where("predicted = 1")
    ids = lambda df: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.collect())
    assert kept.dtypes == mixed.dtypes and ids(kept) == ids(good)
