"""Parallelism guard before per-row heavy work (parse, fold, hashing, scoring).

A large input arrives in many files / row groups and is already split into
enough scan tasks; then nothing is added.  A small input stored as one row
group becomes a single task, so it is spread round-robin over the cluster's
default parallelism first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


# Rows of a short table that a join may broadcast.
BROADCAST_ROWS = 100_000

# Logical nodes that end in a shuffle (a coalesce, "Repartition n, false", does not).
_SHUFFLING = re.compile(r"Repartition \d+, true|RepartitionByExpression|Aggregate|Join|Window|"
                        r"Sort |Distinct|Expand")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    qe = df._jdf.queryExecution()
    logical = qe.optimizedPlan().toString()
    if _SHUFFLING.search(logical):
        return df  # already laid out by a shuffle with the session's partition count
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    # a plan without exchanges: building its RDD lists the input splits, runs no job
    if qe.executedPlan().execute().getNumPartitions() < target:
        return df.repartition(target)
    return df


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for plans that read it in several branches (e.g.
    parsed pages feeding both sides of the link join): a reliable checkpoint
    in the session's shared ``spark.checkpoint.dir`` cuts the lineage, so an
    expensive upstream step (a Python parse) is neither repeated per branch
    nor re-run after a lost executor."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like ``materialize``, compressed and read by column.
    ``drop_written`` removes it behind its last reader."""
    from ..session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_side(df: DataFrame, name: str) -> DataFrame:
    """``written`` for the short side of a join: planned by its size on disk, so a short one is broadcast and the
    other side is not shuffled.  One of more than ``BROADCAST_ROWS`` rows is merge-joined."""
    out = written(df, name)
    return out if out.count() <= BROADCAST_ROWS else out.hint("merge")


def drop_written(df: DataFrame) -> None:
    """Removes a table of ``written`` from the shared folder."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
