"""Full-text search over knowledge: an inverted index as a table of postings, ranked by BM25.

Tokens are lower-case runs of ASCII letters and digits, and pairs of neighbouring ideographs. Scores are
BM25 with fixed constants, not those of any particular library.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: What entries are searched in.
FIELDS = ("brief", "message", "description", "cause", "action")


_PLAIN, _IDEOGRAPHS = re.compile("[a-z0-9]+"), re.compile("[\u3400-\u9fff]+")


def tokens(text: Column) -> Column:
    """All tokens of a text in the order of their kind: words, then pairs of ideographs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[\x{3400}-\x{9FFF}]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))))
    return F.concat(words, pairs)


def index(docs: DataFrame, key: str, *fields: str) -> DataFrame:
    """Postings ``doc, token, tf, length``."""
    text = F.concat_ws("\n", *(F.col(f) for f in fields))
    rows = docs.select(F.col(key).alias("doc"), tokens(text).alias("t")).select("doc", F.size("t").alias("length"), F.explode("t").alias("token"))
    return rows.groupBy("doc", "token", "length").agg(F.count("*").alias("tf"))


def scores(postings: DataFrame, queries: DataFrame, k: int | None = 10, within: str | None = None, counts: tuple[int, float] | None = None) -> DataFrame:
    """``query, doc, score, hits``: for rows ``query, text`` the best documents by BM25 (all with a common token if k is None).

    Query tokens are joined with postings on the token, so that only lists of tokens that are asked for move; with ``within``,
    a column of both, only on postings of the query's own. ``counts`` are the number of documents and their mean length, if they are known.
    """
    own_part = [within] if within else []
    asked = queries.select("query", *own_part, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    if counts is None:
        stats = postings.select("doc", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    else:
        stats = postings.sparkSession.createDataFrame([counts], "n bigint, mean double")
    wanted = asked.select("token").distinct()
    own = postings.join(wanted, "token", "left_semi")
    df = own.groupBy("token").agg(F.count("*").alias("df"))
    hits = own.join(df, "token").crossJoin(F.broadcast(stats))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    made = hits.select("token", "doc", *own_part, part.alias("part")).join(asked, ["token", *own_part]).groupBy("query", "doc").agg(F.sum("part").alias("score"), F.count("*").alias("hits"))
    if k is None:
        return made
    from pyspark.sql import Window

    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return made.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def search(knowledge: DataFrame, text: str = "", module: str = "", severity: int | None = None, entry_type: str = "", sort: str = "relevance", page: int = 1, size: int = 20, postings: DataFrame | None = None) -> DataFrame:
    """Entries that pass all filters and, with a text, hold one of its tokens, with ``score``; at most 100 a page.

    ``postings`` are those of a published index; without them they are made here.
    """
    own = knowledge
    for name, value in (("module", module), ("entry_type", entry_type)):
        if value:
            own = own.where(F.upper(name) == value.upper())
    if severity is not None:
        own = own.where(F.col("severity") == severity)
    if text:
        asked = own.sparkSession.createDataFrame([("q", text)], "query string, text string")
        # scores are those among all entries, whatever the filters
        found = scores(postings if postings is not None else index(knowledge, "id", *FIELDS), asked, None)
        own = own.join(found.select(F.col("doc").alias("id"), "score"), "id")
    else:
        own = own.withColumn("score", F.lit(0.0))
    order = [F.asc("severity"), F.desc("score"), F.asc("id")] if sort == "severity" else [F.desc("score"), F.asc("id")]
    size = max(1, min(size, 100))
    return own.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def highlight(text: Column, query: str) -> Column:
    """``text`` with the words of the query marked."""
    words = [re.escape(w) for w in re.findall(r"[A-Za-z0-9]+|[㐀-鿿]{2,}", query)]
    return F.regexp_replace(text, f"(?i)({'|'.join(words)})", "<mark>$1</mark>") if words else text


def fragment(text: str | None, query: str | None, size: int = 200) -> str | None:
    """The stretch of at most ``size`` characters that begins and ends with words of the query and holds the most of them (different
    ones; of these the shortest, then the first), with each marked; without a word of the query, the text's beginning."""
    if text is None:
        return None
    low, words = text.lower(), set(_PLAIN.findall((query or "").lower())) | _pairs((query or "").lower())
    # lower case changes the length of few letters; where it does, places are those of the text as it is
    low = low if len(low) == len(text) else text
    found = sorted({(m.start(), m.end()) for m in _PLAIN.finditer(low) if m.group() in words} | {(m.start() + k, m.start() + k + n) for m in _IDEOGRAPHS.finditer(low) for n in (1, 2) for k in range(len(m.group()) - n + 1) if m.group()[k : k + n] in words and (n == 2 or len(m.group()) == 1)})
    best, held, first = None, {}, 0
    for start, end in found:
        held[low[start:end]] = held.get(low[start:end], 0) + 1
        # the first word goes while the stretch is too long or holds it once more
        while end - found[first][0] > size or held[low[slice(*found[first])]] > 1:
            if found[first] == (start, end):
                break
            gone = low[slice(*found[first])]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            first += 1
        rank = (-len(held), end - found[first][0], found[first][0])
        best = min(best, (rank, found[first][0], end)) if best else (rank, found[first][0], end)
    if best is None:
        return text[:size]
    _, left, right = best
    out, at = [], left
    for start, end in found:
        if left <= start and end <= right:
            # pairs of ideographs overlap
            start = max(start, at)
            if end > start:
                out += [text[at:start], "<mark>", text[start:end], "</mark>"]
                at = end
    return "".join(out)


def _pairs(low: str) -> set[str]:
    return {p for m in _IDEOGRAPHS.findall(low) for p in ([m] if len(m) == 1 else [m[k : k + 2] for k in range(len(m) - 1)])}


def fragments(hits: DataFrame, text: str = "text", query: str = "asked", size: int = 200) -> DataFrame:
    """``fragment`` beside rows of hits with their text and the query's; hits are a page, or k for each query."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([fragment(t, q, size) for t, q in zip(texts, queries, strict=True)], dtype="object")

    return hits.withColumn("fragment", cut(F.col(text), F.col(query)))


from syslumen.session import by_value  # noqa: E402

by_value(__name__)
