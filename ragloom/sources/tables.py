"""Readers for the driver tables (one parquet file each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def pages(spark, sf_dir):
    """Crawl output (S7): the web source as a table, one row per fetched page."""
    return table(spark, sf_dir, "pages")


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark")


def conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")
