"""Operator 7: benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are lower-cased and cut into words (runs of letters and digits). Two masks pick 6 of 8 or 9
consecutive words and ignore those between; a text and a benchmark item whose picked words agree are a
hit. The masks are chosen so that two stretches of ``WINDOW`` words in line with one another that differ in
at most ``MISMATCHES`` places always have one. Around a hit, the words of text and item that stand in line
are compared one by one, and the pair is a leak if some ``WINDOW`` words in line differ in at most
``MISMATCHES`` places (a similarity of 0.8 or more).

A seed of the benchmark carries the ``CONTEXT`` words around it that may decide, so that its size is fixed, whatever the length
of its item. Seeds are broadcast in blocks of at most ``SEEDS`` rows, whose number is counted first;
every block passes over the texts once. Hits are looked at where they are found, and what is shuffled is a few numbers for each;
hot passages don't meet in one task. Whole lines of words are then compared for the texts and items that have hits.
Items with the same words are one class, named by its smallest id. The number of
hits of a text follows its length times the items that it resembles.

Items of fewer than ``WINDOW`` words, ``LEAST`` at least, leak where all their words stand in line in a text: places of texts and these items are
joined by their first ``LEAST`` words, and the rest is compared there. Where a benchmark has none, nothing is done for them.

Defined cases: a null text has no words; items of fewer than ``LEAST`` words (they are ordinary phrases) and items with a null id
give no leaks; repeated rows of a document give its leaks once; a null doc_id may have leaks, under null;
empty tables give none; other columns are not looked at. ``drop_leaking`` tells rows by doc_id (null too) and text, so that a row
stays whose id another, leaking row has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syslumen.llm import _common as C

WINDOW, MISMATCHES, LEAST = 13, 2, 5
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Words of a text that are looked at together.
PIECE = 512
#: Seeds of the benchmark that are broadcast at a time: with their context, some 40 MB.
SEEDS = 200_000
#: Words before and after the first of a hit that may be in a stretch with it.
BEFORE, AFTER = WINDOW - 1 - min(m[-1] for m in MASKS), WINDOW - 1
CONTEXT = BEFORE + 1 + AFTER
#: Words of the items that have hits, of which the list is broadcast (8 bytes each).
LISTED_WORDS = 2_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _coded(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seed(coded: str, at: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(mask[-1]), *(F.get(F.col(coded), at + k) for k in mask))


def _seeds(df: DataFrame, coded: str, name: str, low: Column, high: Column) -> DataFrame:
    """A row for each mask and each place from ``low`` to ``high`` (not included) of the words ``coded`` where it fits."""
    places = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn(name, F.explode(places))
    fits = [F.when(F.col(name) + m[-1] < F.size(coded), _seed(coded, F.col(name), m)) for m in MASKS]
    return rows.withColumn("seed", F.explode(F.array(*fits))).where("seed is not null")


def _pieces(docs: DataFrame, key: str, text: str, least: int = WINDOW) -> DataFrame:
    """Texts of ``least`` words or more in pieces of ``PIECE`` words with a margin of ``WINDOW`` words on either side, so that no row carries a whole long text.

    ``doc_id``, ``h`` (a hash of the text), ``words``, ``base`` (the place of the first of them), ``low`` and ``high`` (the piece without margins, from the base).
    """
    own = F.col(f"`{text}`")
    words = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(own).alias("h"), _coded(own).alias("all"))

    def piece(at: Column) -> Column:
        base = F.greatest(at - WINDOW, F.lit(0))
        return F.struct(base.alias("base"), (at - base).alias("low"), F.slice("all", base + 1, PIECE + 2 * WINDOW).alias("words"))

    # no filter on the number of words: it would be pushed below the cutting and cut the text again
    starts = F.when(F.size("all") >= least, F.sequence(F.lit(0), F.size("all") - 1, F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
    rows = words.select("doc_id", "h", F.explode(F.transform(starts, piece)).alias("p")).select("doc_id", "h", "p.*")
    return rows.withColumn("high", F.least(F.col("low") + PIECE, F.size("words")))


def _close_by() -> Column:
    """Whether one of the stretches that hold a hit's picked words differs in few enough places; written out, so that it compiles."""
    same = lambda k: F.when(F.get("line", F.lit(k + BEFORE)) == F.get("context", F.lit(k + BEFORE)), 1).otherwise(0)
    out = F.lit(False)
    for start in range(-BEFORE, 1):
        total = same(start)
        for k in range(start + 1, start + WINDOW):
            total = total + same(k)
        out = out | (total >= WINDOW - MISMATCHES)
    return out


def items(benchmark: DataFrame, key: str = "item_id", text: str = "text", short: bool = False) -> DataFrame:
    """``item_id`` (the smallest of equal items) and ``item``, its words as numbers; of long items, or of short ones."""
    rows = benchmark.select(F.col(f"`{key}`").alias("item_id"), _coded(F.col(f"`{text}`")).alias("item"))
    size = F.size("item")
    return rows.where(((size >= LEAST) & (size < WINDOW) if short else size >= WINDOW) & F.col("item_id").isNotNull()).groupBy("item").agg(F.min("item_id").alias("item_id"))


def _around(coded: str, at: str) -> Column:
    return F.array(*(F.get(coded, F.col(at) + k) for k in range(-BEFORE, AFTER + 1)))


def _hits(docs: DataFrame, known: DataFrame, key: str, text: str, shared: C.Shared) -> DataFrame:
    """``doc_id, h, item_id, shift``: alignments of text and item with a hit around which enough words agree."""
    total = known.agg(F.coalesce(F.sum(F.size("item")), F.lit(0)) * len(MASKS)).head()[0]
    blocks = max(1, -(-total // SEEDS))
    pieces, found = _pieces(docs, key, text), None
    for block in range(blocks):
        # places are dealt to blocks, so that a long item is cut too
        places = _seeds(known, "item", "j", F.lit(0), F.size("item")).where(F.pmod(F.xxhash64("item_id", "j"), F.lit(blocks)) == block)
        seeds = places.select("seed", "j", "item_id", _around("item", "j").alias("context"))
        hits = _seeds(pieces, "words", "i", F.col("low"), F.col("high")).join(F.broadcast(seeds), "seed")
        part = hits.select("doc_id", "h", "item_id", (F.col("i") + F.col("base") - F.col("j")).alias("shift"), _around("words", "i").alias("line"), "context")
        # written before they are looked at: both in one stage make code that isn't compiled
        part = shared.write(part, f"hits-{block}").where(_close_by()).select("doc_id", "h", "item_id", "shift")
        found = part if found is None else found.union(part)
    return found.distinct()


def _whole(docs: DataFrame, known: DataFrame, total: int, key: str, text: str) -> DataFrame:
    """``doc_id, h, item_id, item_words, matched`` of short items whose words all stand in line."""
    first = lambda coded, at: F.xxhash64(F.lit(-1), *(F.get(F.col(coded), at + k) for k in range(LEAST)))
    blocks, pieces, found = max(1, -(-total // SEEDS)), _pieces(docs, key, text, LEAST), None
    places = pieces.withColumn("i", F.explode(F.when(F.col("high") > F.col("low"), F.sequence(F.col("low"), F.col("high") - 1)).otherwise(F.array().cast("array<int>"))))
    places = places.where(F.col("i") + LEAST <= F.size("words")).withColumn("seed", first("words", F.col("i")))
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).withColumn("seed", first("item", F.lit(0)))
        part = places.join(F.broadcast(own), "seed").where(F.slice("words", F.col("i") + 1, F.size("item")) == F.col("item"))
        part = part.select("doc_id", "h", "item_id", F.size("item").alias("item_words"), F.size("item").alias("matched"))
        found = part if found is None else found.union(part)
    return found.distinct()


def _matches(docs: DataFrame, benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, h, item_id, item_words, matched`` for the alignments that are leaks."""
    shared = C.Shared(docs.sparkSession)
    long, short = _long(docs, benchmark, key, text, shared), shared.write(items(benchmark, short=True), "short")
    total = short.count()
    return long.unionByName(_whole(docs, short, total, key, text)) if total else long


def _long(docs: DataFrame, benchmark: DataFrame, key: str, text: str, shared: C.Shared) -> DataFrame:
    """The leaks of items of ``WINDOW`` words or more."""
    own = F.col(f"`{text}`")
    known = shared.write(items(benchmark), "items")
    hits = shared.write(_hits(docs, known, key, text, shared), "hits")
    asked = C.listed(shared, hits.select("doc_id", "h").distinct(), "texts")
    rows = docs.select(F.col(f"`{key}`").alias("d"), F.xxhash64(own).alias("g"), own.alias("own"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("h"))
    here = rows.join(asked, same, "left_semi").select("d", "g", _coded(F.col("own")).alias("all"))
    here = here.select("d", "g", F.size("all").alias("n"), F.posexplode("all").alias("pos", "word")).distinct()
    used = known.join(hits.select("item_id").distinct(), "item_id", "left_semi").select("item_id", F.size("item").alias("item_words"), F.posexplode("item").alias("j", "own"))
    used = shared.write(used, "used")
    if used.count() <= LISTED_WORDS:
        used = F.broadcast(used)
    line = hits.join(used, "item_id").withColumn("at", F.col("j") + F.col("shift"))
    agree = line.join(here, same & (F.col("at") == F.col("pos")) & (F.col("own") == F.col("word")))
    agree = agree.groupBy("doc_id", "h", "item_id", "item_words", "shift", "n").agg(F.array_sort(F.collect_list("j")).alias("js"))
    long = F.least(F.col("item_words"), F.col("n") - F.col("shift")) - F.greatest(-F.col("shift"), F.lit(0))
    # so many words that agree, within a stretch
    many = WINDOW - MISMATCHES
    close = F.exists(F.zip_with(F.slice("js", many, F.greatest(F.size("js") - many + 1, F.lit(0))), "js", lambda x, y: x - y), lambda span: span < WINDOW)
    return agree.where((F.size("js") >= many) & (long >= WINDOW) & close).select("doc_id", "h", "item_id", "item_words", F.size("js").alias("matched"))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, matched, item_words``: leaks with the most words in line that agree, over any one alignment."""
    return _matches(docs, benchmark, key, text).groupBy("doc_id", "item_id", "item_words").agg(F.max("matched").alias("matched"))


def drop_leaking(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without those that leak; all columns stay."""
    gone = _matches(df, benchmark, key, text).select("doc_id", "h").distinct()
    return C.of_list(df, C.listed(C.Shared(df.sparkSession), gone, "gone"), key, text, "left_anti")


#: The same by comparing all words that text and item share, in DuckDB.
ORACLE_SQL = rf"""
WITH i AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark) GROUP BY w HAVING len(w) >= {WINDOW} AND min(item_id) IS NOT NULL),
ip AS (SELECT item_id, len(w) AS item_words, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM i),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
dp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
hit AS (SELECT DISTINCT doc_id, item_id, item_words, i - j AS shift, j FROM dp JOIN ip USING (word)),
run AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS n, min(j) OVER w AS low, count(*) OVER w AS matched FROM hit WINDOW w AS (PARTITION BY doc_id, item_id, shift)),
-- a stretch of {WINDOW} words may begin at words that differ, so it is looked at from its last agreeing word too
back AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS m FROM run)
SELECT b.doc_id, b.item_id, CAST(b.item_words AS INT) AS item_words, CAST(max(matched) AS INT) AS matched
FROM back b JOIN (SELECT doc_id, len(w) AS doc_words FROM d) x USING (doc_id)
WHERE (n >= {WINDOW - MISMATCHES} OR m >= {WINDOW - MISMATCHES}) AND least(item_words, doc_words - shift) - greatest(-shift, 0) >= {WINDOW}
GROUP BY ALL
UNION ALL
-- short items: all words in line
SELECT DISTINCT doc_id, item_id, CAST(len(s.w) AS INT), CAST(len(s.w) AS INT)
FROM (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark) GROUP BY w HAVING len(w) BETWEEN {LEAST} AND {WINDOW - 1} AND min(item_id) IS NOT NULL) s
JOIN dp ON dp.word = s.w[1] JOIN d USING (doc_id) WHERE d.w[dp.i : dp.i + len(s.w) - 1] = s.w
"""
