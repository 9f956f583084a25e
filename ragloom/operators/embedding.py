"""Embedding inputs, the batch embedding hook and the bundled
feature-hashing provider.

* ``hashed_vector`` / ``hash_sparse`` / ``hash_dense`` are the bundled
  provider, written as native row-local expressions: tokens are bucketed by
  md5, sorted and run-length counted inside the row, then L2-normalised.
* ``embed`` is the pluggable hook: any ``list[str] -> list[list[float]]``
  callable runs on executors over Arrow batches (``mapInPandas``); its
  output is fitted to the dimension and normalised exactly as the reference
  does for its remote model.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_of, let
from ..functions.vectors import fit_dimension, l2_normalize
from .partitioning import spread

# Reference embedding dimension and per-text input cap.
EMBEDDING_DIMENSION = 768
EMBED_INPUT_CAP = 8000

# Bundled provider defaults (ours): bucket count and token pattern.
HASH_DIM = 256
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def embed_input(df: DataFrame, text_col: str = "text", cap: int = EMBED_INPUT_CAP) -> DataFrame:
    """What a provider with a payload limit receives: numbered pieces (``piece`` from 0, ``embed_text``) of
    at most ``cap`` characters that together are the whole text.  An empty or null text is one piece."""
    t = F.col(text_col)
    last = F.floor((F.greatest(F.coalesce(F.length(t), F.lit(0)), F.lit(1)) - 1) / F.lit(cap))
    out = df.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return out.withColumn("embed_text", F.substring(t, (F.col("piece") * cap + 1).cast("int"), F.lit(cap)))


def token_bucket(token, dim: int):
    """Bucket of a token: first 32 bits of its md5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(col_of(token)), 1, 8), 16, 10).cast("bigint") % F.lit(dim))


def _runs(values):
    """(values, counts) of the runs of a sorted array, in one pass: a run starts where an item differs
    from the one before it."""
    def spans(b):
        starts = F.filter(F.transform(b, lambda x, i: F.when(
            (i == 0) | (x != F.get(b, i - 1)), i)), lambda i: i.isNotNull())

        def count(at):
            ends = F.concat(F.slice(at, 2, 1 << 30), F.array(F.size(b)))
            return F.struct(F.transform(at, lambda i: F.get(b, i)).alias("values"),
                            F.zip_with(at, ends, lambda s, e: (e - s).cast("bigint")).alias("counts"))
        return let(starts, count)
    return let(values, spans)


def tokens_of(text):
    return F.array_remove(F.split(F.lower(col_of(text)), TOKEN_SPLIT, -1), "")


def hashed_counts(text, dim: int = HASH_DIM):
    """Row-local term counting: (buckets ARRAY<BIGINT>, counts ARRAY<BIGINT>) for the whole text, buckets
    ascending.  Tokens are hashed, sorted and run-length counted inside the row (no explode, no shuffle)."""
    sorted_buckets = F.sort_array(F.transform(tokens_of(text), lambda t: token_bucket(t, dim)))
    return let(_runs(sorted_buckets), lambda r: F.struct(r["values"].alias("buckets"), r["counts"].alias("counts")))


def term_weights(text):
    """(tokens ARRAY<BIGINT>, weights): 64-bit token hashes with unit-length term-frequency weights."""
    def scale(r):
        norm = F.sqrt(F.aggregate(r["counts"], F.lit(0).cast("bigint"), lambda acc, c: acc + c * c))
        return let(norm, lambda n: F.struct(r["values"].alias("tokens"),
                                            F.transform(r["counts"], lambda c: c / n).alias("weights")))
    return let(_runs(F.sort_array(F.transform(tokens_of(text), lambda t: F.xxhash64(t)))), scale)


def hashed_vector(text, dim: int = HASH_DIM):
    """E2 bundled provider, sparse form in the row: (buckets, weights) with
    unit L2 norm."""
    def norm_of(hc):
        def scale(norm):
            return F.struct(hc["buckets"].alias("buckets"),
                            F.transform(hc["counts"], lambda c: c / norm).alias("weights"))
        return let(F.sqrt(F.aggregate(hc["counts"], F.lit(0).cast("bigint"),
                                      lambda acc, c: acc + c * c)), scale)
    return let(hashed_counts(text, dim), norm_of)


def hash_sparse(df: DataFrame, key_col: str, text_col: str = "text", dim: int = HASH_DIM) -> DataFrame:
    """(key, bucket, weight) rows, unit L2 norm per key."""
    v = spread(df).select(key_col, hashed_vector(F.col(text_col), dim).alias("v"))
    return v.select(key_col, F.inline(F.arrays_zip(F.col("v.buckets").alias("bucket"),
                                                    F.col("v.weights").alias("weight"))))


def dense_from_sparse(buckets, weights, dim: int):
    return let(F.map_from_arrays(col_of(buckets), col_of(weights)), lambda m: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.element_at(m, i.cast("bigint")), F.lit(0.0).cast("double"))))


def hash_dense(df: DataFrame, key_col: str, text_col: str = "text", dim: int = HASH_DIM,
               keep: list[str] | None = None) -> DataFrame:
    """E2 bundled provider, dense form (ARRAY<DOUBLE> of ``dim``), unit length; ``keep``: further columns to carry."""
    v = spread(df).select(key_col, *(keep or []), hashed_vector(F.col(text_col), dim).alias("_hashed"))
    return v.select(key_col, *(keep or []), dense_from_sparse(F.col("_hashed.buckets"), F.col("_hashed.weights"), dim)
                    .alias("embedding"))


def _provider_udf(provider: Callable[[list[str]], list[list[float]]], text_col: str,
                  out_col: str):
    def run(batches):
        for pdf in batches:
            vecs = provider(pdf[text_col].tolist()) if len(pdf) else []
            pdf[out_col] = [np.asarray(v, dtype="float64").tolist() for v in vecs]
            yield pdf
    return run


def embed(df: DataFrame, provider: Callable[[list[str]], list[list[float]]],
          text_col: str = "text", out_col: str = "embedding",
          dim: int = EMBEDDING_DIMENSION, input_cap: int | None = None) -> DataFrame:
    """E2 hook: run ``provider`` on executors over Arrow batches, then E3 + E4.

    With ``input_cap`` a longer text reaches the provider as pieces of at most
    that many characters and gets the mean of their vectors; nothing is cut off.
    Call it on a persisted or written input so the provider is not invoked
    twice when the result feeds more than one action.
    """
    if input_cap is None:
        schema = T.StructType(df.schema.fields + [T.StructField("_raw", T.ArrayType(T.DoubleType()))])
        raw = df.mapInPandas(_provider_udf(provider, text_col, "_raw"), schema=schema)
        return raw.withColumn(out_col, l2_normalize(fit_dimension(F.col("_raw"), dim))).drop("_raw")

    def whole(texts: list[str]) -> list:
        pieces = [[t[i:i + input_cap] for i in range(0, max(1, len(t or "")), input_cap)] if t else [t] for t in texts]
        vectors = iter(provider([p for ps in pieces for p in ps]))
        return [np.mean([np.asarray(next(vectors), dtype="float64") for _ in ps], axis=0) for ps in pieces]

    return embed(df, whole, text_col, out_col, dim)


def hashing_provider(dim: int = HASH_DIM) -> Callable[[list[str]], list[list[float]]]:
    """A pure-Python stand-in for a remote model, for tests of the hook only
    (the Spark-native ``hash_dense`` is the production path)."""
    import hashlib

    import regex

    pat = regex.compile(r"[^\p{L}\p{N}]+")

    def provider(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for tok in pat.split(t.lower()):
                if tok:
                    v[int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % dim] += 1
            out.append(v.tolist())
        return out

    return provider


