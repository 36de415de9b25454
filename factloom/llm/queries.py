"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import (
    aligned,
    attribution,
    decontam,
    jaccard,
    language,
    lines,
    merkle,
    packing,
    repeats,
    secrets,
    topk,
    toxicity,
    vectors,
)
from factloom.llm.store import read_table


def tokenizer_file(name: str) -> str:
    """Where a vocabulary file of the public tokenizers is; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_query(read_table(spark, folder, "documents"))


def op2_near_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(read_table(spark, folder, "embeddings"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_scan_query(read_table(spark, folder, "documents"))


def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_sets(read_table(spark, folder, "documents"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.token_count_query(read_table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op7_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeats_query(read_table(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_query(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_dedup_query(read_table(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest_query(read_table(spark, folder, "documents"))


def op12_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k_query(read_table(spark, folder, "embeddings"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return aligned.alignment_query(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_near_embeddings": op2_near_embeddings,
    "op3_decontamination": op3_decontamination,
    "op4_secret_scan": op4_secret_scan,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_token_counts": op6_token_counts,
    "op7_repeated_strings": op7_repeated_strings,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_top_k": op12_top_k,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op10_line_dedup": lines.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_top_k": topk.ORACLE,
}
