"""Inference whose results are kept between jobs.

A memo is a table keyed by model and input.  A job looks up its distinct inputs, runs the batch function on
those that are not in it, appends their outputs, and joins the outputs back to its rows.  An input that stands
in a large share of the rows is counted before anything is shuffled by it, and its output is copied to as many
keys as its rows need.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .partitioning import materialize

ENTRY = "model string, input_hash string, output string"
HOT_SHARE = 1000            # an input in more than 1/1000 of the rows is hot, so fewer than 1000 are
HOT_ROWS = 10_000           # and has at least so many rows; its rows are dealt to keys of about this size or share


class InferenceMemo:
    """The memo table under ``path`` (shared storage)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self, model: str) -> DataFrame:
        """(input_hash, output) of everything computed with ``model``; an output that two jobs computed counts once."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/entries")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], "input_hash string, output string")
        rows = self.spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(f"{self.path}/entries")
        return rows.where(F.col("model") == model).groupBy("input_hash").agg(F.min("output").alias("output"))

    def infer(self, df: DataFrame, fn: Callable[[list[str]], list[str]], model: str, input_col: str = "prompt",
              out_col: str = "response", new_col: str | None = None) -> DataFrame:
        """``df`` with ``out_col``: ``fn`` (a batch function, run on executors) of each distinct input that the
        memo does not know, and what it knows of the others.  ``model`` names the function; another name shares
        nothing.  A null input has a null output and reaches no function.  ``new_col``: whether this job
        computed the row's output.  Outputs are in the memo when this returns; ``df`` is computed once."""
        df = materialize(df.withColumn("_hash", F.sha2(F.col(input_col).cast("binary"), 256)))
        counted = materialize(df.where("_hash IS NOT NULL").groupBy("_hash").agg(
            F.count(F.lit(1)).alias("_rows"), F.min(input_col).alias("_input")))
        known = self.read(model)
        todo = materialize(counted.select("_hash", "_input").join(
            known.select(F.col("input_hash").alias("_hash")), "_hash", "left_anti"))

        def run(batches):
            for pdf in batches:
                pdf["output"] = list(fn(pdf["_input"].tolist())) if len(pdf) else []
                yield pdf[["_hash", "output"]]

        computed = todo.mapInPandas(run, "_hash string, output string")
        (computed.select(F.lit(model).alias("model"), F.col("_hash").alias("input_hash"), "output")
         .write.parquet(f"{self.path}/entries/{uuid.uuid4().hex}"))
        outputs = (self.read(model).withColumnRenamed("input_hash", "_hash").withColumnRenamed("output", out_col)
                   .join(counted.select("_hash"), "_hash", "left_semi"))
        if new_col:
            outputs = outputs.join(todo.select("_hash", F.lit(True).alias("_new")), "_hash", "left").withColumn(
                new_col, F.coalesce("_new", F.lit(False))).drop("_new")

        share = max(HOT_ROWS, -(-(counted.agg(F.sum("_rows")).first()[0] or 0) // HOT_SHARE))
        # fewer than HOT_SHARE rows, whatever the table: a broadcast of proven size
        hot = F.broadcast(counted.where(F.col("_rows") > share).select(
            "_hash", F.ceil(F.col("_rows") / share).cast("int").alias("_keys")))
        rows = df.join(hot, "_hash", "left").withColumn("_salt", F.when(
            F.col("_keys").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_keys"))).otherwise(0).cast("int"))
        copies = outputs.join(hot, "_hash", "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_keys", F.lit(1)) - 1)))
        return rows.drop("_keys").join(copies.drop("_keys"), ["_hash", "_salt"], "left").select(
            *[F.col(f"`{c}`") for c in df.columns if c != "_hash"], F.col(out_col),
            *([F.coalesce(new_col, F.lit(False)).alias(new_col)] if new_col else []))
