"""The queries of this package, by name, with SQL where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.llm import _common as C
from syslumen.llm import bpe, codebooks, decontaminate, filteraudit, langid, linededup, neighbours, packing, pii, quality, simhash, tokencount, toxicity


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # without a key of the session, one that nobody keeps: pseudonyms are linked within this run
    key = spark.conf.get("spark.syslumen.pii.key", None) or secrets.token_hex(16)
    return pii.pseudonymise(C.read(spark, sf_dir, "documents"), key).select("doc_id", "n_replaced", "text")


def op2_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = C.file_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.with_digest(C.read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(C.read(spark, sf_dir, "documents"))


def op5_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = tokencount.pieces_of(C.file_bytes(public_tokenizers.path("piece_bpe_32k.model")))
    return tokencount.count_tokens(C.read(spark, sf_dir, "documents"), pieces)


def op6_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


def op8_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(C.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", F.length("text").alias("chars_left"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op10_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(C.read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op11_kd_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.encode(C.read(spark, sf_dir, "embeddings"))
    found = codebooks.with_label_error(coded).select("vec_id", "code", "error", "label_error")
    return found.withColumn("codebooks_sha256", F.lit(codebooks.digest(books)))


def op12_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = C.file_bytes(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(C.read(spark, sf_dir, "documents"), model, public_tokenizers.PATTERN)


def op13_filter_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pii": op1_feistel_pii,
    "op2_quality_fourier": op2_quality_fourier,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_kernel": op4_language_kernel,
    "op5_trie_tokens": op5_trie_tokens,
    "op6_toxicity_gru": op6_toxicity_gru,
    "op7_spaced_seeds": op7_spaced_seeds,
    "op8_multiprobe": op8_multiprobe,
    "op9_line_runs": op9_line_runs,
    "op10_simhash_bk": op10_simhash_bk,
    "op11_kd_codebooks": op11_kd_codebooks,
    "op12_vector_best_fit": op12_vector_best_fit,
    "op13_filter_cube": op13_filter_cube,
}

ORACLES: dict[str, str] = {
    "op7_spaced_seeds": decontaminate.ORACLE_SQL,
    "op9_line_runs": linededup.ORACLE_SQL,
    "op11_kd_codebooks": codebooks.ORACLE_SQL,
    "op13_filter_cube": filteraudit.ORACLE_SQL,
}
