"""Operator 9: repeated runs of lines, found with a suffix array over line ids, in DataFrame functions only.

Lines are what "\n" separates. A line's id is its rank among the lines that occur more than once; only
those can be part of a repeated run, so all else is left out at once. The suffix array of the remaining
sequences is made by prefix doubling: level j ranks the stretches of 2^j lines by the pair of ranks of
their halves, and ranks come from a sort that is dealt out by range (ids that grow along sorted
partitions), never from a sort in one task. Stretches that occur once have no rank.

A run of n lines is the interval of suffixes whose longest common prefix is n lines or more, and is named
by n and the ranks of its first and its last 2^j lines (2^j <= n < 2^(j+1)). Runs looked at are, from
every line on, and up to every line, the shortest that hold ``min_words`` words: a line lies in a
maximal repeated run of at least that many words exactly if it lies in such a shortest run that is
repeated. Levels are needed only up to the longest of these. The earliest copy of a run, by (doc_id,
hash of the text, line number), stays; the lines of all later ones are deleted.

Defined cases: a null text stays null and has no lines; an empty text has one empty line, which by itself
has no words and stays; a text all of whose lines go becomes empty; blank lines count as lines of no
words and go where they lie within a deleted run; rows with the same doc_id and text are one document
and get the same result; null ids come first in the order; an empty table gives none; other columns are
kept as they are, whatever their names, but for ``n_lines`` and ``n_deleted``, which the counts replace.

Runs are held as intervals, which are united before the text is put together, so that the work grows with the number of lines,
whatever the length of runs. Lines, stretches and runs that very many places share are joined where the places lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syslumen.llm import _common as C

MIN_WORDS = 8

_DOC = ("d", "t")


def _words(line: Column) -> Column:
    """Words of a line: its blanks that follow something else, and one, if it isn't blank.

    Lines whose blanks are single spaces between words, as nearly all are, need no regular expression.
    """
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | (line == "")
    for blank in ("\t", "\r", "\x0b", "\x0c"):
        odd = odd | line.contains(blank)
    bare = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(~odd, spaces(line) + 1).when(bare == "", 0).otherwise(spaces(bare) + 1)


def _repeated(shared: C.Shared, rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``by``, ``rank`` and ``n``: numbers in the order of ``by`` for what occurs more than once, and how often."""
    counted = shared.write(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), name)
    partitions = max(1, -(-counted.count() // 200_000))
    return shared.write(counted.repartitionByRange(partitions, *by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), f"{name}-ranks")


def suffix_levels(shared: C.Shared, first: DataFrame, levels: int, name: str = "level") -> list[DataFrame]:
    """Level 0 to ``levels`` of the suffix array: ``d, t, island, pos, rank``, rank null where a stretch occurs once or doesn't fit."""
    out = [first]
    for j in range(levels):
        along = Window.partitionBy(*_DOC, "island").orderBy("pos")
        pairs = out[-1].withColumn("next", F.lead("rank", 1 << j).over(along)).withColumnRenamed("rank", "here")
        pairs = shared.write(pairs, f"{name}-{j}-pairs")
        full = F.col("here").isNotNull() & F.col("next").isNotNull()
        ranks = _repeated(shared, pairs.where(full), ["here", "next"], f"{name}-{j}-names")
        # rows without a pair would all meet under null
        made = C.hot_join(pairs.where(full), ranks, ["here", "next"], "n", "left").select(*_DOC, "island", "pos", "rank")
        made = made.union(pairs.where(~full).select(*_DOC, "island", "pos", F.lit(None).cast("bigint")))
        out.append(shared.write(made, f"{name}-{j + 1}"))
        shared.drop(f"{name}-{j}-pairs")
    return out


def _shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """``d, t, start, n``: the shortest runs with enough words from each line on and up to each line."""
    upto = F.sum("w").over(Window.partitionBy(*_DOC, "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("w"))
    where = [*_DOC, "island"]
    # for lines asked about (ask) and lines that may end a run, by words so far: the first end at or after what is asked
    ends = lines.select(*where, F.col("upto").alias("at"), F.col("pos").alias("to"), F.lit(None).cast("int").alias("ask"))
    asks = lines.select(*where, (F.col("before") + min_words).alias("at"), F.lit(None).cast("int").alias("to"), F.col("pos").alias("ask"))
    down = Window.partitionBy(*where).orderBy(F.desc("at"), F.col("ask").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    on = ends.union(asks).withColumn("end", F.min("to").over(down)).where("ask is not null and end is not null").select(*_DOC, F.col("ask").alias("start"), (F.col("end") - F.col("ask") + 1).alias("n"))
    starts = lines.select(*where, F.col("before").alias("at"), F.col("pos").alias("to"), F.lit(None).cast("int").alias("ask"))
    asks = lines.select(*where, (F.col("upto") - min_words).alias("at"), F.lit(None).cast("int").alias("to"), F.col("pos").alias("ask"))
    up = Window.partitionBy(*where).orderBy(F.asc("at"), F.col("ask").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    back = starts.union(asks).withColumn("start", F.max("to").over(up)).where("ask is not null and start is not null").select(*_DOC, "start", (F.col("ask") - F.col("start") + 1).alias("n"))
    return on.union(back).where("n > 0").distinct()


def deletions(df: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``d`` (doc_id), ``t`` (hash of the text) and ``gone``, the intervals ``low`` to ``high`` (from 0) of the lines that go, in order, for documents that lose any."""
    shared = C.Shared(df.sparkSession)
    docs = df.select(F.col(f"`{key}`").alias("d"), F.xxhash64(f"`{text}`").alias("t"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("pos", "line"))
    # two hashes of different seeds and the length stand for a line
    lines = docs.select("d", "t", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(9), "line").alias("b"), _words(F.col("line")).alias("w"))
    lines = shared.write(lines, "lines")
    ids = _repeated(shared, lines.dropDuplicates(["d", "t", "pos"]), ["a", "b"], "ids")
    kept = C.hot_join(lines, ids, ["a", "b"], "n").select("d", "t", "pos", "w", "rank").dropDuplicates(["d", "t", "pos"])
    along = Window.partitionBy(*_DOC).orderBy("pos")
    kept = shared.write(kept.withColumn("island", F.col("pos") - F.row_number().over(along)), "repeated")
    runs = shared.write(_shortest_runs(kept, min_words), "runs")
    longest = runs.agg(F.coalesce(F.max("n"), F.lit(1))).head()[0]
    levels = suffix_levels(shared, kept.select("d", "t", "island", "pos", "rank"), max(0, longest.bit_length() - 1))
    named = None
    for j, level in enumerate(levels):
        ranks = level.where("rank is not null").select("d", "t", "pos", "rank")
        same = lambda left, at, right: F.col(f"{left}.d").eqNullSafe(F.col(f"{right}.d")) & (F.col(f"{left}.t") == F.col(f"{right}.t")) & (at == F.col(f"{right}.pos"))
        own = runs.where((F.col("n") >= 1 << j) & (F.col("n") < 2 << j)).alias("r")
        made = own.join(ranks.alias("x"), same("r", F.col("r.start"), "x")).select("r.*", F.col("x.rank").alias("first")).alias("s")
        if j:
            made = made.join(ranks.alias("y"), same("s", F.col("s.start") + F.col("s.n") - (1 << j), "y")).select("s.*", F.col("y.rank").alias("last"))
        else:
            made = made.withColumn("last", F.col("first"))
        named = made if named is None else named.union(made)
    named = shared.write(named, "intervals")
    place = F.struct("d", "t", "start")
    runs_of = ["n", "first", "last"]
    earliest = named.groupBy(*runs_of).agg(F.min(place).alias("earliest"), F.count("*").alias("copies")).where("copies > 1")
    later = C.hot_join(named, shared.write(earliest, "earliest"), runs_of, "copies").where(place > F.col("earliest"))
    return _united(later.groupBy(*_DOC, "start").agg(F.max(F.col("start") + F.col("n") - 1).alias("end")))


def _united(spans: DataFrame) -> DataFrame:
    """``d, t, gone``: the union of a document's spans ``start`` to ``end``."""
    by = Window.partitionBy(*_DOC).orderBy("start")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    parts = spans.withColumn("part", F.sum("fresh").over(by)).groupBy(*_DOC, "part").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    return parts.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("gone"))


#: ``doc_id, n_lines, n_deleted, chars_left, text_sha256`` in DuckDB, by comparing runs' whole texts; doc_id must be unique.
ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id AS d, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS (SELECT d, pos, len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) AS w FROM (SELECT d, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l)),
u AS (SELECT *, sum(w) OVER (PARTITION BY d ORDER BY pos) AS upto FROM p),
r AS (SELECT a.d, a.pos AS low, min(b.pos) AS high FROM u a JOIN u b ON a.d = b.d AND b.pos >= a.pos AND b.upto >= a.upto - a.w + {MIN_WORDS} GROUP BY a.d, a.pos
      UNION SELECT b.d, max(a.pos), b.pos FROM u a JOIN u b ON a.d = b.d AND b.pos >= a.pos AND a.upto - a.w <= b.upto - {MIN_WORDS} GROUP BY b.d, b.pos),
k AS (SELECT d, low, high, md5(array_to_string(ls[low:high], chr(10))) AS run FROM r JOIN l USING (d)),
f AS (SELECT *, first_value({{'d': d, 'low': low}}) OVER (PARTITION BY high - low, run ORDER BY d, low) AS first FROM k),
g AS (SELECT DISTINCT d, unnest(range(low, high + 1)) AS pos FROM f WHERE {{'d': d, 'low': low}} <> first),
n AS (SELECT d, list(pos) AS gone FROM g GROUP BY d),
o AS (SELECT l.d, ls, coalesce(gone, []) AS gone FROM l LEFT JOIN n USING (d)),
t AS (SELECT d, ls, gone, array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i)), chr(10)) AS text FROM o)
SELECT d AS doc_id, CAST(len(ls) AS INT) AS n_lines, CAST(len(gone) AS INT) AS n_deleted, CAST(length(text) AS INT) AS chars_left, sha256(text) AS text_sha256 FROM t
"""


def dedup(df: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id", counts: bool = True) -> DataFrame:
    """``df`` with later copies of repeated runs taken out of ``text``; with counts, ``n_lines`` and ``n_deleted`` besides."""
    d, h, gone, t = C.fresh(df, "d_", "h_", "gone_", "t_")
    spans = deletions(df, min_words, text, key).withColumnsRenamed({"d": d, "t": h, "gone": gone})
    own = F.col(f"`{text}`")
    left = df.withColumn(t, F.xxhash64(own)).join(spans, F.col(f"`{key}`").eqNullSafe(F.col(d)) & (F.col(t) == F.col(h)), "left")

    def rest(lines: Column) -> Column:
        low = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g["high"] + 1))
        high = F.concat(F.transform(gone, lambda g: g["low"]), F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(low, high, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    # as an element of an array, so that the text is cut up once
    cut = F.get(F.transform(F.array(F.split(own, "\n")), rest), F.lit(0))
    kept = [c for c in df.columns if not counts or c.lower() not in ("n_lines", "n_deleted")]
    n_deleted = F.aggregate(gone, F.lit(0), lambda s, g: s + (g["high"] - g["low"] + 1).cast("int"))
    more = [F.coalesce(F.size(F.split(own, "\n")), F.lit(0)).alias("n_lines"), F.coalesce(n_deleted, F.lit(0)).alias("n_deleted")] if counts else []
    return left.select(*(F.when(F.col(gone).isNull(), own).otherwise(cut).alias(c) if c == text else F.col(f"`{c}`") for c in kept), *more)
