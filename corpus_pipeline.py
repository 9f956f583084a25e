"""Corpus pipeline: raw documents to packed token windows in five stages.

Each stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.common import fold, table
from ragloom.llm.jaccard_join import one_per_component
from ragloom.llm.language_id import UNDETERMINED, identify_language
from ragloom.llm.line_dedup import dedup_lines
from ragloom.llm.mixing import repeated_documents
from ragloom.llm.packing import pack_documents
from ragloom.session import scratch_path

MIN_LANGUAGE_SCORE = 0.5
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a recognised language; rejects those without a letter and undecided ones."""
    rows = docs.select("doc_id", "lang", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    out = identify_language(rows, fold(F.col("doc_id"), 3) != 1, ["__row"], "__row.text")
    return out.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("__row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines out of the texts; n_chars follows the text."""
    return dedup_lines(docs, short=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return one_per_component(docs, NEAR_SHINGLE, NEAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the source mix, repeated or left out whole."""
    return repeated_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# Predicting a language is not SQL; the tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
