"""Training-set curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_training_text, pair_parts
from .partitioning import spread

PAIR_MARK = " || "


def read_examples(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A JSON array of ``{"text": ...}`` objects (or CSV with a ``text``
    header column)."""
    if fmt == "csv":
        return spark.read.option("header", True).option("multiLine", True).csv(path).select("text")
    return spark.read.option("multiLine", True).json(path).select("text")


def clean_distinct(examples: DataFrame, text_col: str = "text") -> DataFrame:
    """X17 + A3: strip, newlines to spaces, distinct (order not kept).  The
    distinct is a partial + final aggregate, so copies of one text are
    collapsed map-side before the shuffle."""
    return spread(examples).select(clean_training_text(F.col(text_col)).alias("text")).distinct()


def split_pairs(examples: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``question || answer`` rows -> (pairs, rejects without the mark)."""
    parts = examples.withColumn("_p", pair_parts(F.col(text_col)))
    pairs = (parts.where(F.size("_p") == 2)
             .withColumn("question", F.col("_p")[0]).withColumn("answer", F.col("_p")[1]).drop("_p"))
    rejects = parts.where(F.size("_p") < 2).drop("_p")
    return pairs, rejects


def pair_turns(conversations: DataFrame) -> DataFrame:
    """Build ``question || answer`` examples from a user turn and the
    assistant turn right after it (equi-join on (conv_id, turn + 1), so a
    long conversation is not gathered in one task)."""
    u = conversations.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    a = conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return u.join(a, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.concat(F.col("q"), F.lit(PAIR_MARK), F.col("a")).alias("text"))
