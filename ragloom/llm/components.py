"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LAYOUT = 997  # weights of the fingerprint that tells a settled edge table


def _fingerprint(edges: DataFrame) -> tuple:
    mix = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(F.pmod(mix, F.lit(1 << 40))), F.sum(F.pmod(mix, F.lit(_LAYOUT)))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component: its smallest node.

    Both stars take a minimum per node (partial aggregation) and an equi-join, never a list of
    neighbours; rounds grow with the logarithm of the longest path.  Each round is checkpointed."""
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) \
        .filter(F.col("u") != F.col("v")).distinct().checkpoint()
    seen = _fingerprint(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour points to the smallest node around u
        large = (both.filter(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours point to the smallest of them
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        edges = small.filter(F.col("u") != F.col("v")).distinct().checkpoint()
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
