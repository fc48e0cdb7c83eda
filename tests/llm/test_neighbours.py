import random

import numpy as np
import pytest

from syslumen.llm import neighbours as N

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, queries, k=5):
    x = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q in queries:
        score = {i: float(v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q])) for i, v in x.items() if i != q}
        out[q] = sorted(score, key=lambda i: (-round(score[i], 12), i))[:k], score
    return out


def found(df, queries, k=5):
    by = {}
    for r in N.nearest(df, queries, k).orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return by


def test_recall_on_clustered_and_on_random_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    for x in (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 32)), rng.normal(size=(2000, 32))):
        rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
        got, want = found(df, df.where("vec_id % 50 = 0")), brute(rows, range(0, len(rows), 50))
        assert set(got) == set(want)
        hits = sum(len({v for _, v, _ in got[q]} & set(want[q][0])) for q in want)
        assert hits >= 0.9 * 5 * len(want)
        for q, answers in got.items():
            assert [r for r, *_ in answers] == [1, 2, 3, 4, 5]
            assert all(s == pytest.approx(want[q][1][v], abs=1e-12) for _, v, s in answers)
            assert [s for *_, s in answers] == sorted((s for *_, s in answers), reverse=True)


@pytest.mark.parametrize("asked", [2, 4096])
def test_large_groups_of_equal_vectors_and_split_buckets(spark, monkeypatch, asked):
    monkeypatch.setattr(N, "GROUP", 16)
    monkeypatch.setattr(N, "ASKED", asked)
    rng = random.Random(3)
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got, want = found(df, df.where("vec_id % 50 = 0")), brute([(i, np.array(v, np.float32)) for i, v in rows], range(0, 300, 50))
    for q in (0, 150):
        assert [v for _, v, _ in got[q]] == want[q][0]
    assert all(len(v) == 5 for v in got.values())


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, None], 1), (8, [], 1), (9, [1.0, 2.0, 3.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {q: [v for _, v, _ in a] for q, a in found(df, df).items()} == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    assert N.nearest(df.limit(0), df.limit(0)).count() == 0
    assert N.nearest(df, df.where("vec_id = 3")).count() == 0


def test_perturbations_come_cheapest_first():
    h = N.Hasher(8, 4)
    x = np.random.default_rng(2).normal(size=(5, 8))
    slots = h.slots(x)
    probes = h.probes(slots, 20)
    assert np.array_equal(probes[:, :, 0], h.buckets(slots))
    assert all(len(set(p[p != 0])) == (p != 0).sum() for row in probes for p in row)
    expected = h.sets(30)
    assert expected[0] == (0,) and len(set(expected)) == len(expected)
