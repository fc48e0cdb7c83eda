"""Small document tables with the awkward rows that every operator must bear."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, rank int, `a.b` string"

AWKWARD = [
    (1, None, "en", "s", None, 0.1, 1, "x"),
    (2, "", "en", "s", 0, 0.1, 1, "x"),
    (3, "   \n\t ", None, "s", 6, 0.1, 1, "x"),
    (4, "word " * 60_000, "en", None, 300_000, 0.1, 1, "x"),
    (5, "The same text, twice.", "en", "s", 21, None, None, None),
    (5, "The same text, twice.", "en", "s", 21, None, None, None),
    (None, "A row without an id.", "de", "s", 20, 0.1, 1, "x"),
    (6, "Ünïcödé ΑΒΓ 日本語 😀 ▁ \x00", "fr", "s", 20, 0.1, 1, "x"),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
