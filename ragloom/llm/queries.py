"""Registered queries of the subpackage: operator N over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encoding_digests
from .common import table
from .filter_audit import ORACLE as FILTER_AUDIT_SQL
from .filter_audit import filter_audit
from .jaccard_join import ORACLE as JACCARD_SQL
from .jaccard_join import jaccard_components
from .language_id import language_id
from .line_dedup import line_dedup
from .line_rules import ORACLE as LINE_RULES_SQL
from .line_rules import quality_rules
from .mixing import ORACLE as MIXING_SQL
from .mixing import mixed_documents
from .packing import pack_documents
from .pii import personal_data
from .quality import quality_scores
from .token_counts import token_counts
from .topk import ORACLE as TOPK_SQL
from .topk import exact_top_k
from .vector_codes import ORACLE as VECTOR_CODES_SQL
from .vector_codes import vector_codes


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), short=True)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), ["doc_id"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), ["doc_id"])


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), ["vec_id"], "label")


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_topk": op6_topk,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_line_frequency": op10_line_frequency,
    "op11_filter_audit": op11_filter_audit,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}
LLM_ORACLE: dict[str, str] = {
    "op5_jaccard_join": JACCARD_SQL,
    "op6_topk": TOPK_SQL,
    "op8_mixing": MIXING_SQL,
    "op10_line_frequency": LINE_RULES_SQL,
    "op11_filter_audit": FILTER_AUDIT_SQL,
    "op13_vector_codes": VECTOR_CODES_SQL,
}
