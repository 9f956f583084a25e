"""Paragraph packing, chunk fan-out with stable ids, chunk statistics.

Packing runs inside the row that holds the document (no shuffle): the text is
split into paragraphs and folded with the higher-order ``aggregate`` function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NON_WS_CLASS, col_of, java_literal

# Reference chunk size (characters, separators not counted) and
# paragraph separator.
CHUNK_SIZE = 1000
PARAGRAPH_SEP = "\n\n"


def chunk_text(text, chunk_size: int = CHUNK_SIZE, sep: str = PARAGRAPH_SEP) -> Column:
    """ARRAY<STRING> of chunks.

    Paragraphs (split on ``sep``) that are blank are skipped; the rest are
    packed greedily: the current chunk is flushed when adding the next
    paragraph would take its character count (without separators) above
    ``chunk_size``.  A lone paragraph above the limit stays whole.  When no
    paragraph survives, the result is ``[text]``.
    """
    t = col_of(text)
    paras = F.filter(F.split(t, java_literal(sep), -1), lambda p: p.rlike(NON_WS_CLASS))
    init = F.struct(
        F.array().cast("array<string>").alias("chunks"),
        F.lit("").alias("cur"),
        F.lit(0).cast("long").alias("size"),
        F.lit(False).alias("has"),
    )

    def step(acc, p):
        n = F.length(p).cast("long")
        flush = acc["has"] & ((acc["size"] + n) > F.lit(chunk_size))
        return F.when(
            flush,
            F.struct(F.array_append(acc["chunks"], acc["cur"]).alias("chunks"),
                     p.alias("cur"), n.alias("size"), F.lit(True).alias("has")),
        ).otherwise(
            F.struct(acc["chunks"].alias("chunks"),
                     F.when(acc["has"], F.concat(acc["cur"], F.lit(sep), p)).otherwise(p).alias("cur"),
                     (acc["size"] + n).alias("size"), F.lit(True).alias("has")))

    def finish(acc):
        return F.when(acc["has"], F.array_append(acc["chunks"], acc["cur"])).otherwise(F.array(t))

    return F.aggregate(paras, init, step, finish)


def explode_chunks(df: DataFrame, key_col: str, text_col: str = "text",
                   chunk_size: int = CHUNK_SIZE, sep: str = PARAGRAPH_SEP,
                   keep: list[str] | None = None) -> DataFrame:
    """C1 + C2: one row per chunk with ``chunk_index`` (from 0) and
    ``chunk_id = {key}_doc_{i}``; ``keep`` columns (metadata) are copied."""
    keep = keep or []
    return (df.select(key_col, *keep,
                      F.posexplode(chunk_text(F.col(text_col), chunk_size, sep))
                      .alias("chunk_index", "text"))
            .withColumn("chunk_id", F.concat(F.col(key_col).cast("string"), F.lit("_doc_"),
                                             F.col("chunk_index").cast("string")))
            .withColumn("chunk_index", F.col("chunk_index").cast("bigint")))


def file_key(path) -> Column:
    """Base name of a path with every ``.`` replaced by ``_``."""
    return F.replace(F.element_at(F.split(col_of(path), "/"), -1), F.lit("."), F.lit("_"))


def url_key(url) -> Column:
    """md5 hex of the URL."""
    return F.md5(col_of(url))


def chunk_stats(chunks: DataFrame, key_col: str) -> DataFrame:
    """C4: chunks and characters per document (partial + final aggregate)."""
    return (chunks.groupBy(key_col)
            .agg(F.count(F.lit(1)).alias("n_chunks"),
                 F.sum(F.length("text")).cast("bigint").alias("total_chars"),
                 F.max(F.length("text")).cast("bigint").alias("max_chars")))
