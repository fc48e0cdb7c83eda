"""Audit of how filters interact: what each order of five filters removes at each step, for every part of a corpus.

The texts are read once, for five failure flags a document (A few words, B few different words, C many capitals, D signs of
markup, E a copy of an earlier text). What follows sees counts only. A CUBE over the flags and the part gives the rows of every
grouping set; in a set, the row whose chosen flags are all false counts the documents that those filters together let pass, in
whatever order. A step of an order is then a pair of such subsets, before and after its filter, so that 80 pairs a part give the 600
steps of all 120 orders.

Defined results: a null text is empty; a null part is the empty string; a document without an id is nobody's copy and has no
labels; rows of equal id and text are no copies of each other, and each counts; of several labels of a document the
worst counts (1 if any is). Parts are what the table holds: an empty table gives no rows. Columns of other names are not
looked at. Copies are told by the SHA-256 of their texts.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syslumen.llm import _common as C

FILTERS = "ABCDE"
#: Fewest words, least share of different words and largest share of capitals (in percent).
WORDS, DISTINCT, CAPITALS = 50, 65, 5


def flags(text: Column) -> dict[str, Column]:
    """What fails the filters that look at one text, by letter."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    # letters A-Z take one byte each
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT * n,
        "C": 100 * capitals > CAPITALS * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id, part, A..E`` of every document."""
    shared = C.Shared(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("t"))
    own = own.select("doc_id", "part", *(c.alias(k) for k, c in flags(F.col("t")).items()), F.unhex(F.sha2("t", 256)).alias("digest"))
    own = shared.write(own, "flags")
    # texts that occur more than once; groups of copies are as large as they like, so that hot ones are joined where they lie
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    told = C.hot_join(own, shared.write(first, "copies"), ["digest"], "n", "left")
    return told.select("doc_id", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with ``good`` and ``toxic``, 1 where some label of the document says so and 0 elsewhere."""
    shared = C.Shared(rows.sparkSession)
    rows = shared.write(rows, "rows")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    often = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    marks = shared.write(marks.where("good + toxic > 0").join(often, "doc_id"), "marks")
    known = C.hot_join(rows.where("doc_id IS NOT NULL"), marks, ["doc_id"], "n", "left")
    unknown = rows.where("doc_id IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    return known.unionByName(unknown).fillna(0, ["good", "toxic"])


def survivors(rows: DataFrame) -> DataFrame:
    """``part, subset, n, good, toxic`` for all 32 subsets of filters, as bits from A on: what passes every filter of the subset."""
    spark = rows.sparkSession
    cells = rows.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.sum(F.col("good").cast("bigint")).alias("good"), F.sum(F.col("toxic").cast("bigint")).alias("toxic"))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    cube = cells.cube(*FILTERS, "part").agg(*sums, *(F.grouping(f).alias(f"g{f}") for f in FILTERS), F.grouping("part").alias("g_part"))
    passed = F.lit(True)
    subset = F.lit(0)
    for k, f in enumerate(FILTERS):
        passed = passed & ((F.col(f"g{f}") == 1) | ~F.col(f))
        subset = subset + F.when(F.col(f"g{f}") == 0, 1 << k).otherwise(0)
    found = cube.where(passed & (F.col("g_part") == 0)).select("part", subset.alias("subset"), "n", "good", "toxic")
    # subsets that nothing passes have no row of their own
    every = cells.select("part").distinct().join(F.broadcast(spark.range(1 << len(FILTERS)).select(F.col("id").cast("int").alias("subset"))))
    return every.join(found, ["part", "subset"], "left").fillna(0, ["n", "good", "toxic"])


def steps() -> list[tuple[str, int, str, int, int, int, int]]:
    """``filter_order, step, letter, before, after, alone, others`` of all orders: the subsets that a step is told from."""
    out, every = [], (1 << len(FILTERS)) - 1
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), k + 1, f, before, before | bit, bit, every & ~bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for every part, order and step."""
    spark = docs.sparkSession
    shared = C.Shared(spark)
    counts = shared.write(survivors(labelled(failures(docs, key, text, part), labels)), "survivors")
    every = (1 << len(FILTERS)) - 1
    at = lambda name: counts.select("part", F.col("subset").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "good", "toxic")))
    # pairs of subsets that differ by one filter: before and after it
    pairs = at("before").join(F.broadcast(spark.createDataFrame(sorted({(s[2], s[3], s[4], s[5], s[6]) for s in steps()}), "letter string, before int, after int, alone int, others int")), "before")
    pairs = pairs.join(at("after"), ["part", "after"])
    single = at("alone").select("part", "alone", "alone_n")
    rest = at("others").select("part", "others", "others_n")
    ends = counts.where(F.col("subset").isin(0, every)).groupBy("part").agg(F.sum(F.when(F.col("subset") == 0, F.col("n"))).alias("all_n"), F.sum(F.when(F.col("subset") == every, F.col("n"))).alias("none_n"))
    pairs = pairs.join(single, ["part", "alone"]).join(rest, ["part", "others"]).join(ends, "part")
    removed = F.col("before_n") - F.col("after_n")
    # the orders in which just these filters come before
    size = F.bit_count("before").cast("int")
    orders = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), size + 1)
    told = pairs.select(
        "part", "letter", "before", F.col("after_n").alias("kept"), removed.alias("removed"), (F.col("all_n") - F.col("alone_n") - removed).alias("redundant"),
        (F.col("others_n") - F.col("none_n")).alias("unique_fails"), (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"),
        (removed * orders).alias("share"),
    )
    shapley = told.groupBy("part", "letter").agg(F.sum("share").cast("bigint").alias("shapley"))
    placed = F.broadcast(spark.createDataFrame([s[:4] for s in steps()], "filter_order string, step int, letter string, before int"))
    made = told.join(shapley, ["part", "letter"]).join(placed, ["letter", "before"])
    return made.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: Every order is applied to every document, filter by filter.
ORACLE_SQL = r"""
WITH own AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM own
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT w.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, map {
    'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
    'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > w.first, false)} AS f
  FROM words w LEFT JOIN marks m ON m.doc_id = w.doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), told AS (
  SELECT part, good, toxic, f, filter_order, s AS step, substr(filter_order, s, 1) AS letter,
    f[substr(filter_order, s, 1)] AS fails,
    len(list_filter(range(1, s), lambda i: f[substr(filter_order, i, 1)])) > 0 AS gone,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: f[x])) AS n_fails
  FROM failed, orders, range(1, 6) r(s)
), counted AS (
  SELECT part, filter_order, step, letter, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (NOT gone AND fails) AS removed,
    count(*) FILTER (gone AND fails) AS redundant, count(*) FILTER (fails AND n_fails = 1) AS unique_fails,
    count(*) FILTER (NOT gone AND fails AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND fails AND toxic = 1) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
