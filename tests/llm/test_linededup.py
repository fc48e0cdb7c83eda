import random
from collections import defaultdict

from helpers import awkward, empty

from syslumen.llm import linededup


def brute(docs, least):
    """Lines in a repeated run of at least ``least`` words that begins earlier elsewhere, by comparing all pairs of places."""
    places = [(d, i) for d, lines in docs for i in range(len(lines))]
    lines, gone = dict(docs), defaultdict(set)
    for d, i in places:
        for e, j in places:
            if (e, j) >= (d, i):
                break
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n]:
                n += 1
            if sum(len(x.split()) for x in lines[d][i : i + n]) >= least:
                gone[d].update(range(i, i + n))
    return gone


def test_equals_all_pairs_of_places(spark):
    for seed in range(4):
        rng = random.Random(seed)
        pool = ["a b c", "d", "", "e f", "g h i j k l m n o", "p q r s"]
        docs = [(k, [rng.choice(pool) if rng.random() < 0.9 else f"only {k} {i}" for i in range(rng.randrange(1, 14))]) for k in range(14)]
        docs.append((20, docs[0][1] * 3))
        want = brute(docs, 8)
        made = linededup.dedup(spark.createDataFrame([(d, "\n".join(x)) for d, x in docs], "doc_id bigint, text string"), 8).collect()
        for r in made:
            lines = dict(docs)[r["doc_id"]]
            assert r["text"] == "\n".join(x for i, x in enumerate(lines) if i not in want[r["doc_id"]])
            assert (r["n_lines"], r["n_deleted"]) == (len(lines), len(want[r["doc_id"]]))


def test_long_runs_need_several_levels(spark):
    block = [f"w{k}" for k in range(40)]
    rows = [(1, "\n".join(["x", *block])), (2, "\n".join([*block, "y"])), (3, "\n".join(block[:20]))]
    made = {r["doc_id"]: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), 25).collect()}
    assert made[1]["n_deleted"] == 0 and made[2]["text"] == "y" and made[3]["n_deleted"] == 0


def test_suffix_levels_rank_in_order(spark):
    from syslumen.llm._common import Shared

    rng = random.Random(5)
    seqs = {d: [rng.randrange(3) for _ in range(12)] for d in range(5)}
    first = spark.createDataFrame([(d, 0, 0, i, v) for d, s in seqs.items() for i, v in enumerate(s)], "d bigint, t bigint, island int, pos int, rank bigint")
    third = linededup.suffix_levels(Shared(spark), first, 2, "test")[2].where("rank is not null").collect()
    stretch = lambda r: tuple(seqs[r["d"]][r["pos"] : r["pos"] + 4])
    for a in third:
        for b in third:
            assert (a["rank"] < b["rank"]) == (stretch(a) < stretch(b))


def test_columns_with_inner_names(spark):
    rows = [(1, "one two three four five six seven eight", "x", "y", "z", 1), (2, "one two three four five six seven eight\nmore", "x", "y", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, d string, t string, gone string, pos int")
    made = linededup.dedup(df).orderBy("doc_id")
    assert made.columns == [*df.columns, "n_lines", "n_deleted"] and [(r["text"], r["d"]) for r in made.collect()] == [(rows[0][1], "x"), ("more", "x")]


def test_awkward_rows(spark):
    df = awkward(spark)
    made = linededup.dedup(df)
    assert made.columns == [*df.columns, "n_lines", "n_deleted"]
    rows = made.collect()
    assert len(rows) == 8
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0
    assert by[2]["text"] == "" and by[2]["n_deleted"] == 0
    assert [r["n_deleted"] for r in rows if r["doc_id"] == 5] == [0, 0]
    assert linededup.dedup(empty(spark)).count() == 0


def test_long_texts_of_blank_lines(spark):
    text = "\n" * 100_000 + "one two three four five six seven eight nine"
    made = {r["doc_id"]: r for r in linededup.dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")).collect()}
    assert made[1]["n_deleted"] == 0 and made[2]["n_deleted"] == 100_001 and made[2]["text"] == ""


def test_clashing_columns_and_hot_runs(spark, monkeypatch):
    monkeypatch.setattr(linededup.C, "HOT_ROWS", 3)
    line = "one two three four five six seven eight"
    rows = [(k, f"{line}\n{k} a\n{line}", "x", "y", "z", "n") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, t_ string, gone_ string, __t string, n_lines string")
    made = linededup.dedup(df)
    assert made.columns == ["doc_id", "text", "t_", "gone_", "__t", "n_lines", "n_deleted"]
    got = {r["doc_id"]: r for r in made.collect()}
    assert got[0]["text"] == f"{line}\n0 a" and all(got[k]["text"] == f"{k} a" and got[k]["t_"] == "x" for k in range(1, 20))
    assert linededup.dedup(df, counts=False).columns == df.columns
