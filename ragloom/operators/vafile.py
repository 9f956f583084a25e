"""R5 over vector approximations: most vectors are ruled out by one byte per component.

Every stored vector is quantised on its own grid (least component, step; a byte per component), which bounds
how far the vector is from its approximation.  Question blocks meet blocks of approximations; one matrix
product gives all distances to the approximations, and the triangle inequality turns these into a lower and
an upper bound of every distance.  A vector stays a candidate while its lower bound can still reach the k-th
best upper bound, first within the block, then over all blocks.  Only candidates meet the stored vectors, and
only their distances are computed exactly.

Ranking is by (similarity, collection, distance, id), and similarity is flat where a distance passes 1, so
bounds are compared as such tuples: for one vector the tuple grows with the distance, so the tuple of the
lower bound never lies behind the true one, and that of the upper bound never before it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import topk_per_group

BLOCK_ROWS = 2048           # approximations of one block (expected; packing is by hash)
QUESTION_ROWS = 128         # questions of one block
CELLS = 255                 # steps of a vector's grid
PLACES = 9                  # decimals that distances are ranked by
SLACK = 1e-8                # added to bounds, above what rounding to PLACES can move


def _vectors(column: pa.Array):
    """(rows, matrix) for every width among the non-null vectors of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    for width in np.unique(size):
        rows = np.flatnonzero(size == width)
        yield rows, flat[start[rows][:, None] + np.arange(width)].astype(np.float64)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells, least component and step of every row, and a bound of the distance to the approximation
    (infinite for a row with a component that is not finite: it is ruled out by nothing)."""
    finite = np.isfinite(x).all(1)
    y = np.where(finite[:, None], x, 0.0)
    low = y.min(1, initial=0.0) if not x.shape[1] else y.min(1)
    step = (y.max(1) - low) / CELLS if x.shape[1] else np.zeros(len(x))
    cell = np.rint((y - low[:, None]) / np.where(step > 0, step, 1.0)[:, None]).clip(0, CELLS).astype(np.uint8)
    off = np.sqrt(((y - (low[:, None] + cell * step[:, None])) ** 2).sum(1))
    size = np.sqrt((y * y).sum(1))
    return cell, low, step, np.where(finite, off * (1 + 1e-9) + size * 1e-12, np.inf)


def _encode(batches):
    for batch in batches:
        n = batch.num_rows
        cells, low, step, off = [b""] * n, np.zeros(n), np.zeros(n), np.zeros(n)
        for rows, x in _vectors(batch.column(2)):
            cell, low[rows], step[rows], off[rows] = quantise(x)
            for r, c in zip(rows.tolist(), cell, strict=True):
                cells[r] = c.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary()), pa.array(low),
                                          pa.array(step), pa.array(off)], names=["i", "c", "cells", "low", "step", "off"])


def bounds(q: np.ndarray, cell: np.ndarray, low: np.ndarray, step: np.ndarray, off: np.ndarray):
    """Lower and upper bounds (questions, vectors) of squared distances."""
    x = low[:, None] + cell * step[:, None]
    finite = np.isfinite(q).all(1)
    y = np.where(finite[:, None], q, 0.0)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    square = yy[:, None] + xx - 2.0 * (y @ x.T)
    error = (yy[:, None] + xx) * (8 + q.shape[1]) * 2.0 ** -52     # of the product form
    least = np.sqrt(np.maximum(square - error, 0.0))
    most = np.sqrt(np.maximum(square, 0.0) + error)
    lower, upper = np.maximum(least - off, 0.0) ** 2, (most + off) ** 2
    lower[~finite], upper[~finite] = 0.0, np.inf
    return lower - SLACK * (1 + lower), upper + SLACK * (1 + upper)


def _reach(lower, upper, c_rank, i_rank, k):
    """Rows whose lower bound can still be among the k first by upper bound."""
    if len(lower) <= k:
        return np.arange(len(lower))
    sim_low, sim_up = np.maximum(0.0, 1.0 - lower), np.maximum(0.0, 1.0 - upper)
    worst = np.partition(-sim_up, k - 1)[k - 1]
    at = np.flatnonzero(-sim_low <= worst)
    last = at[np.lexsort((i_rank[at], upper[at], c_rank[at], -sim_up[at]))[k - 1]]
    # tuple comparison with the k-th by upper bound
    ahead = -sim_low[at] < -sim_up[last]
    even = -sim_low[at] == -sim_up[last]
    ahead |= even & (c_rank[at] < c_rank[last])
    even &= c_rank[at] == c_rank[last]
    ahead |= even & ((lower[at] < upper[last]) | (lower[at] == upper[last]) & (i_rank[at] <= i_rank[last]))
    return at[ahead]


def _ranks(values: pa.Array) -> np.ndarray:
    """Order numbers, nulls first as Spark sorts them."""
    names = values.to_pylist()
    order = {v: n for n, v in enumerate(sorted({v for v in names if v is not None}), 1)}
    return np.array([0 if v is None else order[v] for v in names], np.int64)


def _candidates(k, scale, batches):
    for batch in batches:
        for r in range(batch.num_rows):
            qi, qv = batch.column(0).slice(r, 1).flatten().flatten()
            i, c, cells, low, step, off = batch.column(1).slice(r, 1).flatten().flatten()
            low, step, off = (x.to_numpy() for x in (low, step, off))
            i_rank, c_rank, raw = _ranks(i), _ranks(c), cells.to_pylist()
            width = np.array([len(x) for x in raw], np.int64)
            out = []
            for rows, q in _vectors(qv):
                at = np.flatnonzero(width == q.shape[1])
                if not len(at):
                    continue
                cell = np.frombuffer(b"".join(raw[j] for j in at.tolist()), np.uint8).reshape(len(at), -1)
                lower, upper = bounds(q, cell, low[at], step[at], off[at])
                for j, row in enumerate(rows.tolist()):
                    lo, up = scale * lower[j], scale * upper[j]
                    hit = _reach(lo, up, c_rank[at], i_rank[at], k)
                    out.append((np.full(len(hit), row), at[hit], lo[hit], up[hit]))
            if out:
                row, hit, lo, up = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(row)), i.take(pa.array(hit)), c.take(pa.array(hit)),
                                                  pa.array(lo), pa.array(up)], names=["qi", "i", "c", "lower", "upper"])


def candidates(stored: DataFrame, questions: DataFrame, k: int, scale: float = 1.0) -> DataFrame:
    """(qi, i, c): pairs whose distance has to be computed for the k best of every question.

    ``stored``: i, c (string), v; ``questions``: qi, qv; vectors of doubles, not null.  A pair of vectors of
    different width is none.  Counts reach the driver.  The pairs are a written table (``written_side``)."""
    n_blocks = max(1, -(-stored.count() // BLOCK_ROWS))
    n_parts = max(1, -(-questions.count() // QUESTION_ROWS))
    itype, qtype = stored.schema["i"].dataType, questions.schema["qi"].dataType
    real = T.DoubleType()
    cells = T.StructType().add("i", itype).add("c", "string").add("cells", "binary").add("low", real).add("step", real).add("off", real)
    s = stored.select("i", "c", "v").mapInArrow(_encode, cells)
    s = s.groupBy(F.pmod(F.xxhash64("i", "c", "cells"), F.lit(n_blocks)).cast("int").alias("block")).agg(
        F.collect_list(F.struct(*cells.names)).alias("s"))
    q = questions.groupBy(F.pmod(F.xxhash64("qi"), F.lit(n_parts)).alias("part")).agg(
        F.collect_list(F.struct("qi", "qv")).alias("q"))
    q = q.select("q", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    # copied for every block of vectors, so never broadcast
    found = q.hint("merge").join(s, "block").select("q", "s").mapInArrow(
        partial(_candidates, k, scale), T.StructType().add("qi", qtype).add("i", itype).add("c", "string")
        .add("lower", real).add("upper", real))

    def place(d):
        return [(-F.greatest(F.lit(0.0), 1.0 - F.col(d))).alias("a"), F.col("c").alias("b"), F.col(d).alias("d"), F.col("i").alias("e")]

    from .partitioning import drop_written, written, written_side
    found = written(found, "topk-bounds")
    order = [F.struct(*place("upper")).asc()]
    last = topk_per_group(found, ["qi"], order, k, "_n").where(F.col("_n") == k).select(
        F.col("qi").alias("_qi"), F.struct(*place("upper")).alias("_last"))
    kept = found.join(last, found.qi == last._qi, "left").where(
        F.col("_last").isNull() | (F.struct(*place("lower")) <= F.col("_last")))
    pairs = written_side(kept.select("qi", "i", "c").distinct(), "topk-pairs")
    drop_written(found)
    return pairs
