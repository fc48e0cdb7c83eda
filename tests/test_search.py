"""Searches on the published index against looks at all postings, deltas against rebuilds, fragments against all stretches."""

from __future__ import annotations

import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from syslumen.operators import indexing, search

WORDS = ["the", "of", "link", "peer", "down", "optical", "接口状态", "备", "crc", "error", "x1", "bgp", "lost"]


def corpus(spark, n, seed=1):
    rng = random.Random(seed)
    # a few words are in most documents, most in few
    rows = [(k, " ".join(rng.choices(WORDS + [f"w{rng.randint(0, 300)}" for _ in range(4)], weights=[40, 30, 9, 8, 7, 5, 4, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 40)))) for k in range(n)]
    return spark.createDataFrame(rows, "id bigint, text string").repartition(3)


def told(df):
    return sorted((r["query"], r["doc"], round(r["score"], 9), r["hits"]) for r in df.collect())


def postings(df):
    return sorted((r["doc"], r["token"], r["tf"], r["length"]) for r in df.collect())


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(indexing, "PER_BUCKET", 1000)


@pytest.mark.parametrize("block", [1, 128])
def test_a_search_of_the_index_gives_what_all_postings_give(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(indexing, "BLOCK", block)
    docs, root = corpus(spark, 600), str(tmp_path / "index")
    indexing.rebuild(root, docs, "id", "text")
    queries = spark.createDataFrame([(1, "optical link"), (2, "the"), (3, "the of bgp crc"), (4, "接口"), (5, "w7 w8 w9 lost"), (6, "nothing here"), (7, ""), (8, None), (9, "the the the")], "query int, text string")
    for k in (1, 3, 20):
        assert told(indexing.find(spark, root, queries, k)) == told(search.scores(search.index(docs, "id", "text"), queries, k))
    assert told(indexing.find(spark, root, queries, None)) == told(search.scores(search.index(docs, "id", "text"), queries, None))


def test_buckets_tokens_and_blocks_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexing, "BLOCK", 8)
    docs, root = corpus(spark, 2000), str(tmp_path / "index")
    folder = indexing.rebuild(root, docs, "id", "text")
    query = spark.createDataFrame([(1, "the")], "query int, text string")
    found = indexing.find(spark, root, query, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*bucket#\d+ = \d", plan) and re.search(r"PushedFilters: \[[^\n]*EqualTo\(token,the\)", plan)
    # the blocks that pass, told by the same bounds
    whole = spark.read.parquet(f"{root}/{folder}/blocks").where(F.col("token").isin("the")).count()
    assert whole > 200 and 0 < len(list(_passed(spark, root, folder, ("the",), 3))) <= 5


def _passed(spark, root, folder, tokens, k):
    last = indexing._newest(spark, root)
    n, mean = last["documents"], last["length"] / last["documents"]
    import math

    weight = lambda tf, length: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    terms = {r["token"]: (math.log1p((n - r["df"] + 0.5) / (r["df"] + 0.5)), sorted((weight(x["tf"], x["length"]) for x in r["best"]), reverse=True)) for r in spark.read.parquet(f"{root}/{folder}/terms").where(F.col("token").isin(*tokens)).collect()}
    sure, total = max(i * w[k - 1] if len(w) >= k else 0 for i, w in terms.values()), sum(i * w[0] for i, w in terms.values())
    for r in spark.read.parquet(f"{root}/{folder}/blocks").where(F.col("token").isin(*tokens)).collect():
        idf, w = terms[r["token"]]
        if idf * r["most"] + total - idf * w[0] >= sure * (1 - 1e-9):
            yield r


def test_additions_and_deletions_are_what_a_rebuild_is(spark, tmp_path):
    root, docs = str(tmp_path / "index"), corpus(spark, 200)
    old = docs.withColumn("text", F.when(F.col("id") % 5 == 0, F.lit("an older text")).otherwise(F.col("text")))
    indexing.rebuild(root, old.where("id < 150"), "id", "text")
    indexing.add(root, docs.where("id >= 150 OR id % 5 = 0"), "id", "text")
    indexing.delete(root, docs.where("id % 7 = 0").select("id"))
    # what was deleted comes back with another addition, and a text without a word takes its document out
    indexing.add(root, docs.where("id = 7").withColumn("text", F.lit("back again")), "id", "text")
    indexing.add(root, docs.where("id = 8").withColumn("text", F.lit("...")), "id", "text")
    want = docs.where("(id % 7 <> 0 OR id = 7) AND id <> 8").withColumn("text", F.when(F.col("id") == 7, F.lit("back again")).otherwise(F.col("text")))
    whole = str(tmp_path / "whole")
    indexing.rebuild(whole, want, "id", "text")
    queries = spark.createDataFrame([(1, "the optical back"), (2, "older"), (3, "link of 接口")], "query int, text string")
    found = told(indexing.find(spark, whole, queries, 5))
    assert postings(indexing.current(spark, root)) == postings(indexing.current(spark, whole))
    assert told(indexing.find(spark, root, queries, 5)) == found
    indexing.compact(spark, root)
    assert [p["kind"] for p in indexing._newest(spark, root)["parts"]] == [indexing.BASE]
    assert postings(indexing.current(spark, root)) == postings(indexing.current(spark, whole)) and told(indexing.find(spark, root, queries, 5)) == found
    # back to the parts of before, which say the same
    indexing.roll_back(spark, root)
    assert len(indexing._newest(spark, root)["parts"]) == 5 and postings(indexing.current(spark, root)) == postings(indexing.current(spark, whole))


def test_a_compaction_keeps_what_others_add_meanwhile(spark, tmp_path, monkeypatch):
    root, docs = str(tmp_path / "index"), corpus(spark, 60)
    indexing.rebuild(root, docs.where("id < 40"), "id", "text")
    write = indexing._write

    def slow(*args):
        made = write(*args)
        monkeypatch.setattr(indexing, "_write", write)
        indexing.add(root, docs.where("id >= 40"), "id", "text")
        return made

    monkeypatch.setattr(indexing, "_write", slow)
    indexing.compact(spark, root)
    assert [p["kind"] for p in indexing._newest(spark, root)["parts"]] == [indexing.BASE, indexing.ADDED]
    assert postings(indexing.current(spark, root)) == postings(search.index(docs, "id", "text"))


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root, docs = str(tmp_path / "index"), corpus(spark, 50)
    indexing.rebuild(root, docs.where("id < 10"), "id", "text")
    threads = [threading.Thread(target=indexing.add, args=(root, docs.where(f"id >= {k} AND id < {k + 10}"), "id", "text")) for k in (10, 20, 30, 40)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["seq"] for r in indexing.pointers(spark, root).collect()) == [1, 2, 3, 4, 5]
    assert postings(indexing.current(spark, root)) == postings(search.index(docs, "id", "text"))


def test_an_empty_index(spark, tmp_path):
    root, docs = str(tmp_path / "index"), corpus(spark, 5).where("id < 0")
    indexing.rebuild(root, docs, "id", "text")
    assert indexing.current(spark, root).count() == 0
    assert indexing.find(spark, root, spark.createDataFrame([(1, "the")], "query int, text string")).count() == 0


def plain_fragment(text, query, size):
    """Over all stretches that begin and end with a word of the query."""
    words = set(re.findall("[a-z0-9]+", query.lower()))
    found = [(m.start(), m.end(), m.group()) for m in re.finditer("[a-z0-9]+", text.lower()) if m.group() in words]
    best = None
    for i, a in enumerate(found):
        for b in found[i:]:
            if b[1] - a[0] <= size or a is b:
                inside = [f for f in found if a[0] <= f[0] and f[1] <= b[1]]
                rank = (-len({f[2] for f in inside}), b[1] - a[0], a[0])
                best = min(best, (rank, inside)) if best else (rank, inside)
    if best is None:
        return text[:size]
    out, at = "", best[1][0][0]
    for a, b, _ in best[1]:
        out += text[at:a] + "<mark>" + text[a:b] + "</mark>"
        at = b
    return out


def test_fragments_are_the_best_of_all_stretches(spark):
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rng = random.Random(2)
    for text in items[:60]:
        for query in (rng.choice(items), " ".join(rng.sample(text.split(), min(4, len(text.split())))), "zzz"):
            for size in (20, 60, 200):
                assert search.fragment(text, query, size) == plain_fragment(text, query, size)
    assert search.fragment(None, "a") is None and search.fragment("abc", None, 2) == "ab"
    assert search.fragment("设备接口状态变化", "接口状态", 10) == "设备接口状态变化"[2:2] + "<mark>接口</mark><mark>状</mark><mark>态</mark>"
    rows = search.fragments(spark.createDataFrame([(1, "a link is down", "Down LINK"), (2, None, "x")], "id int, text string, asked string")).collect()
    assert [r["fragment"] for r in rows] == ["<mark>link</mark> is <mark>down</mark>", None]


def test_scores_do_not_follow_filters(spark):
    rows = [(k, "BGP" if k % 2 else "OSPF", 3, "LOG", "B", f"peer {'lost ' * (k % 3)}", "", "", "") for k in range(12)]
    kb = spark.createDataFrame(rows, "id bigint, module string, severity int, entry_type string, brief string, message string, description string, cause string, action string")
    whole = {r["id"]: r["score"] for r in search.search(kb, "peer lost").collect()}
    some = {r["id"]: r["score"] for r in search.search(kb, "peer lost", module="bgp").collect()}
    assert len(some) == 6 and all(whole[k] == pytest.approx(v) for k, v in some.items())
