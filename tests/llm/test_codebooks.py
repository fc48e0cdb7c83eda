"""kd-trees against all distances, and codes against a plain version of the whole contract."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from syslumen.llm import codebooks as K


def test_nearest_is_that_of_all_distances():
    rng = np.random.default_rng(1)
    # small ranges make many ties and equal entries
    for width, most in ((4, 3), (4, 200), (1, 5), (2, 2)):
        book = rng.integers(-most, most + 1, (64, width))
        q = rng.integers(-most - 2, most + 3, (500, width))
        index, best, looked = K.nearest(book, K.tree(book), q)
        d = ((q[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        assert looked <= 64 * 500
        if most == 200:
            assert looked < 0.8 * 64 * 500


def plain(rows, parts=16, entries=64, rounds=2):
    """``{vec_id: (code, error)}`` and the codebooks, in integers of Python."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in sorted(kept)[:entries]] for p in range(parts)]
    near = lambda book, q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v in kept:
                own[near(books[p], cut(v, p))[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(q) for x in zip(*q, strict=True)] if q else c for q, c in zip(own, books[p], strict=True)]
    out = {}
    for i, v in kept:
        found = [near(books[p], cut(v, p)) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, books


def test_codes_are_those_of_the_plain_version(spark):
    rng = random.Random(2)
    rows = [(k * 3, [rng.choice([rng.uniform(-1, 1), 0.25, -0.5]) for _ in range(32)]) for k in range(150)]
    rows += [(1000, None), (1001, [None] * 32), (1002, [float("nan")] * 32), (1003, [float("inf")] + [0.0] * 31), (1004, [0.1] * 31)]
    labels = {i: (None if i % 4 == 0 else i % 3) for i, _ in rows}
    df = spark.createDataFrame([(i, v, labels[i], "x") for i, v in rows], "vec_id long, embedding array<double>, label int, code string").repartition(4)
    coded, books = K.encode(df)
    want, want_books = plain([r for r in rows if r[1] is None or len(r[1]) == 32])
    assert [b.tolist() for b in books] == want_books
    got = K.with_label_error(coded).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want
    for r in got:
        assert r["label_error"] == sum(e for i, (_, e) in want.items() if labels[i] == labels[r["vec_id"]])


def test_few_rows_repeated_ids_and_none(spark):
    schema = "vec_id long, embedding array<float>, label string"
    few = spark.createDataFrame([(2, [0.5] * 16, "a"), (2, [0.25] * 16, None), (None, [0.3] * 16, "a")], schema)
    coded, books = K.encode(few)
    assert [len(b) for b in books] == [2] * 16
    # of one id the lesser vector comes first; the row without an id lies nearer to it
    assert sorted((str(r["vec_id"]), r["code"][:2]) for r in coded.collect()) == [("2", "00"), ("2", "01"), ("None", "00")]
    coded, books = K.encode(spark.createDataFrame([], schema))
    assert coded.collect() == [] and books == [] and K.with_label_error(coded).collect() == []
    assert K.encode(spark.createDataFrame([(None, [0.1] * 16, "a")], schema))[0].collect() == []


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="scale them down"):
        K.encode(df)


def test_codes_are_decoded(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, [rng.uniform(-1, 1) for _ in range(16)], 0) for k in range(60)], "vec_id long, embedding array<double>, label int")
    coded, books = K.encode(df)
    rows = coded.withColumn("v", K.decode(coded["code"], books)).join(df.select("vec_id", "embedding"), "vec_id").collect()
    assert len(rows) == 60
    for r in rows:
        assert sum((a - b) ** 2 for a, b in zip(r["v"], r["embedding"], strict=True)) <= (math.sqrt(r["error"]) + 4) ** 2 / 256**2
