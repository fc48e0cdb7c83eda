import random
import re
from itertools import combinations

import duckdb
from helpers import awkward, empty

from syslumen.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            best = 0
            if D.LEAST <= len(v) < D.WINDOW and any(w[k : k + len(v)] == v for k in range(len(w))):
                best = len(v)
            for shift in range(-len(v), len(w)):
                same = [w[j + shift] == v[j] for j in range(len(v)) if 0 <= j + shift < len(w)]
                if any(sum(same[k : k + D.WINDOW]) >= D.WINDOW - D.MISMATCHES for k in range(len(same) - D.WINDOW + 1)):
                    best = max(best, sum(same))
            if best:
                out.add((d, i, len(v), best))
    return out


def test_masks_fit_every_pair_of_mismatches():
    for pair in combinations(range(D.WINDOW), D.MISMATCHES):
        assert any(all(p - s not in m for p in pair) for m in D.MASKS for s in range(D.WINDOW - m[-1]))


def test_equals_brute_force_and_sql(spark):
    rng = random.Random(1)
    pool = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(8, 30)))) for k in range(12)]
    docs = []
    for k in range(60):
        w = [rng.choice(pool) for _ in range(rng.randrange(50))]
        item = rng.choice(items)[1].split()
        for _ in range(rng.randrange(5)):
            item[rng.randrange(len(item))] = "edited"
        at = rng.randrange(len(w) + 1)
        docs.append((k, ", ".join([*w[:at], *item[rng.randrange(4) :], *w[at:]]).title()))
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert want
    assert {tuple(r) for r in D.leaks(a, b).select("doc_id", "item_id", "item_words", "matched").collect()} == want
    con = duckdb.connect()
    con.register("documents", a.toPandas())
    con.register("benchmark", b.toPandas())
    assert set(con.execute(D.ORACLE_SQL).fetchall()) == want


def test_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(9)], "item_id bigint, text string")
    docs = items.selectExpr("item_id as doc_id", "concat('before ', text) as text")
    monkeypatch.setattr(D, "SEEDS", 100)
    assert {tuple(r) for r in D.leaks(docs, items).collect()} == {(k, k, 20, 20) for k in range(9)}


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 20), (4, "word " * 20), (None, "x " * 20)], "item_id bigint, text string")
    found = D.leaks(awkward(spark), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(4, 3)]
    assert D.leaks(empty(spark), bench).count() == 0
    assert D.leaks(awkward(spark), bench.limit(0)).count() == 0
    kept = D.drop_leaking(awkward(spark), bench)
    assert kept.columns == awkward(spark).columns and kept.count() == 7


def test_a_long_item_and_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(D, "SEEDS", 10_000)
    rng = random.Random(6)
    item = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    rows = [(1, " ".join(["before", *item[9000:9100]])), (1, "another text of this id"), (2, "x"), (None, " ".join(item[5:40]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in D.leaks(docs, bench).collect()} == {(1, 1, 20_000, 100), (None, 1, 20_000, 35)}
    assert sorted(r["text"] for r in D.drop_leaking(docs, bench).collect()) == ["another text of this id", "x"]


def test_short_items_leak_whole(spark):
    rng = random.Random(9)
    pool = [f"w{k}" for k in range(4)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(n))) for k, n in enumerate([4, 5, 5, 6, 7, 8, 12, 12, 13])] + [(50, "one two three four five"), (51, "One, two; three four five."), (None, "a b c d e f")]
    docs = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for k in range(40)]
    docs += [(100, items[6][1].title()), (101, "so " + items[7][1] + " it was"), (102, "one two three four five"), (102, "one two three four six"), (103, " ".join(["x"] * 510) + " one two three four five"), (None, items[5][1]), (104, None), (105, "a b c d e f")]
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for i, item in items:
        w = words(item)
        if i is not None and 5 <= len(w) < D.WINDOW:
            i = min(j for j, other in items if j is not None and words(other) == w)
            want |= {(d, i, len(w), len(w)) for d, text in docs for v in [words(text)] if any(v[k : k + len(w)] == w for k in range(len(v)))}
    assert {i for _, i, _, _ in want} >= {1, 6, 7, 50}
    got = {tuple(r) for r in D.leaks(a, b).select("doc_id", "item_id", "item_words", "matched").collect()}
    assert {r for r in got if r[2] < D.WINDOW} == want
    con = duckdb.connect()
    con.register("documents", a.where("doc_id IS NOT NULL AND doc_id <> 102").toPandas())
    con.register("benchmark", b.where("item_id IS NOT NULL").toPandas())
    assert set(con.execute(D.ORACLE_SQL).fetchall()) == {r for r in got if r[0] not in (None, 102)}
    assert sorted(r["text"] for r in D.drop_leaking(a.where("doc_id = 102"), b).collect()) == ["one two three four six"]
