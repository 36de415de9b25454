"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

1. language_id drops documents that no known language accepts (no letters, or too far from all centroids);
2. line_dedup removes lines that several documents share from all but the first of them;
3. near_dedup keeps one document of each group of similar ones, the smallest id;
4. decontamination drops documents that hold a copy of a test item;
5. packing gives the pieces of all that is left in training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontam, jaccard, language, lines, packing
from factloom.llm.queries import tokenizer_file
from factloom.llm.store import prepare
from factloom.session import scratch


# The stages share workers, which keep what one batch of the largest stage took: batches are smaller here.
BATCH_ROWS = "500"


def _prepare(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns}), model, "own_text")
    kept = found.filter(~F.col("rejected"))
    return kept.select(*[F.col(f"`own_{c}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return jaccard.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs, benchmark).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL cannot express the fitted model of the first stage nor the search of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
