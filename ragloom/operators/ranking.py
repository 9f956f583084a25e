"""Ranking helpers that never put a whole query's rows in one task.

* ``topk_per_group``: ``row_number() <= k`` - Spark plans a partial
  WindowGroupLimit before the shuffle and a final one after it, so each
  group moves at most ``k`` rows per map partition.
* ``distributed_row_number``: an exact global ``row_number`` per group for
  results that keep every row (R3).  The data is range-partitioned on
  (group, order) - a hot group is spread over many partitions - numbered
  inside each partition, and shifted by per-partition offsets computed from
  a small (partition, group) count table.
* ``weighted_prefix``: per group the leading rows whose weights fit a limit, with
  the same layout: partitions add up their own rows and cut them, a small table
  of partition totals gives the offsets, and only what is left is cut again.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                   out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.  For k below the session's
    ``spark.sql.optimizer.windowGroupLimitThreshold`` the limit is also planned before the shuffle."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return (df.withColumn(out, F.row_number().over(w))
            .where(F.col(out) <= k)
            .withColumn(out, F.col(out).cast("bigint")))


def distributed_row_number(df: DataFrame, group_cols: list[str], order: list[Column],
                           out: str = "rank", num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols] + list(order)
    numbered = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id()))
    # Partition ids and positions must be the same for the count pass and the
    # output pass: cut the lineage on reliable (shared) storage.
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    numbered = numbered.checkpoint(eager=True)
    counts = (numbered.groupBy("_pid", *group_cols)
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select("_pid", *group_cols, "_off", "_first")
    return (numbered.join(offsets, ["_pid", *group_cols])
            .withColumn(out, (F.col("_off") + F.col("_pos") - F.col("_first") + 1).cast("bigint"))
            .drop("_pid", "_pos", "_off", "_first"))


def _local_prefix(limit: int, n_cols: int, batches):
    """Rows sorted by group (last column: its number within the partition's run is counted here).  Adds the
    running count and sum of each group and drops the rows behind the first that passes ``limit``."""
    group, count, total = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        weight = batch.column(n_cols).to_numpy().astype(np.int64)
        key = batch.column(n_cols + 1).to_pylist()
        fresh = np.array([i == 0 and key[0] != group or i > 0 and key[i] != key[i - 1] for i in range(len(key))])
        start = np.flatnonzero(fresh)
        run = np.cumsum(fresh)                              # 0: continues the last batch's group
        base = np.append(total if run[0] == 0 else 0, np.cumsum(weight)[start] - weight[start])
        here = np.cumsum(weight) - np.where(run == 0, -total, base[run])
        place = np.arange(len(key)) + 1
        place = np.where(run == 0, place + count, place - np.append(0, start)[run])
        group, count, total = key[-1], int(place[-1]), int(here[-1])
        keep = pa.array(here - weight <= limit)             # what stood before a row passes the limit: out
        yield pa.RecordBatch.from_arrays(
            [c.filter(keep) for c in [*batch.columns[:n_cols], batch.column(n_cols),
                                      pa.array(place, pa.int64()), pa.array(here, pa.int64())]],
            names=[*batch.schema.names[:n_cols + 1], "_place", "_run"])


def weighted_prefix(df: DataFrame, group_cols: list[str], order: list[Column], weight: Column, limit: int,
                    rank: str = "rank", used: str = "used", num_partitions: int | None = None) -> DataFrame:
    """Per group the rows, in ``order``, whose running sum of ``weight`` (not negative) is within ``limit``: all
    columns, ``rank`` from 1 and ``used``, the running sum.

    Rows are range-partitioned by (group, order), so a group of any size is spread.  A partition drops what its
    own rows already put past the limit; as weights are not negative, nothing of the result is among it.  The
    remaining rows are checkpointed, their totals per (partition, group) give each partition's offset, and the
    sum of both decides.  No window or group holds a group's rows; the offsets' window holds its partitions.
    ``order`` must be total for a result that does not depend on the layout."""
    spark = df.sparkSession
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols] + list(order)
    columns = df.columns
    laid = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
            .select(*columns, F.spark_partition_id().alias("_pid"), weight.cast("long").alias("_weight"),
                    F.to_json(F.struct(*group_cols), {"ignoreNullFields": "false"}).alias("_group")))
    fields = laid.select(*columns, "_pid", "_weight").schema.add("_place", "long").add("_run", "long")
    kept = laid.mapInArrow(partial(_local_prefix, limit, len(columns) + 1), fields).checkpoint(eager=True)
    totals = kept.groupBy("_pid", *group_cols).agg(F.max("_place").alias("_rows"), F.max("_run").alias("_sum"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *group_cols, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_r0"),
                            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_s0")).where(F.col("_s0") <= limit)
    k, o = kept.alias("k"), offsets.alias("o")
    same = F.col("k._pid") == F.col("o._pid")
    for c in group_cols:
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"o.{c}"))
    sums = (F.col("_s0") + F.col("_run")).cast("long")
    return (k.join(o, same).where(sums <= limit)
            .select(*(F.col(f"k.{c}") for c in columns), (F.col("_r0") + F.col("_place")).cast("long").alias(rank),
                    sums.alias(used)))
