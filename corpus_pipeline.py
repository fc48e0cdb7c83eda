"""Corpus preparation in five stages: quality, repeated lines, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and its result is written
as Parquet and read again before the next. All but the last return the columns of documents.

Near-duplicates are texts whose shingles of five words have an exact Jaccard similarity of 0.8 or more, found by the
SimHash operator's trees; the three words and three bits of its own query bind that query only.

Every stage bears null texts and ids, empty texts, repeated rows, empty tables and further columns, as the docstrings of
the operators say: rows are told apart by id and text, so that what one row loses no other row of the same id does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.llm import _common as C
from syslumen.llm import bpe, decontaminate, linededup, quality, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that the classifier gives label 0."""
    return quality.keep_good(docs, C.read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; every document stays, if with an empty text."""
    left = linededup.dedup(docs, counts=False)
    return left.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs, similarity=0.8, width=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.drop_leaking(docs, C.read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document and digests of its ids and of the text that they decode to."""
    import public_tokenizers

    ranks = C.file_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.with_digest(docs, ranks, public_tokenizers.PATTERN, keep=[c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared, docs = C.Shared(spark), C.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = shared.write(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
