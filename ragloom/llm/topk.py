"""Exact top-k inner products with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; the distances of
a pivot are cut into annuli at frozen quantiles.  For a query the triangle inequality
bounds the inner product with any vector of an annulus, so annuli are expanded in
order of that bound: first the best few, which give a k-th score, then every other
annulus whose bound still reaches it.  Bounds only skip vectors that cannot enter the
result, so it is exact whatever the pivots are.

An annulus of any size is stored in blocks of about ``BLOCK`` vectors; query chunks
meet the blocks in an equi-join on (annulus, block) and are scored by one matrix
product per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import hash_share

SCALE = 256.0
FIT_VECTORS = 4096      # vectors the pivots and annuli are fitted on (expected; at most twice that)
PIVOTS, ANNULI = 16, 8
FIRST = 6               # annuli expanded before the rest is bounded by the k-th score
BLOCK, CHUNK = 1024, 256

_MATRIX_CELLS = 1 << 21


def _matrix(raw: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(r, "<i8") for r in raw]
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.zeros((0, 0), np.int64)
    return np.stack([np.pad(r, (0, width - len(r))) for r in rows])    # missing components count as 0


def _same_width(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(x.shape[1], y.shape[1])
    return (np.pad(x, ((0, 0), (0, w - x.shape[1]))), np.pad(y, ((0, 0), (0, w - y.shape[1]))))


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer products; through doubles where every partial sum is an exact double."""
    x, y = _same_width(x, y)
    peak = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if peak < 2.0 ** 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (little-endian longs floor(256 x)) of the vectors that take part."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            flat = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype("<i8")
            end = np.cumsum([len(v) for v in col.to_pylist()])
            raw = [flat[a:b].tobytes() for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(ok).mapInArrow(
        run, "vec_id long, vec binary")


class PivotIndex:
    """Pivots, annulus edges and, once counted, the extent of every annulus."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray):
        self.sample, self.ids = sample, ids
        x = sample.astype(np.float64)
        self.pivots = self._centres(x)
        near, dist = self.nearest(sample)
        grid = np.linspace(0, 1, ANNULI + 1)[1:-1]
        self.edges = np.stack([np.quantile(dist[near == p], grid) if (near == p).any() else np.zeros(ANNULI - 1)
                               for p in range(len(self.pivots))]) if len(self.pivots) else np.zeros((0, ANNULI - 1))

    @staticmethod
    def _centres(x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((0, x.shape[1]))
        chosen, gap = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(PIVOTS, len(x)) and gap.max() > 0:     # farthest first
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
        centre = x[chosen]
        for _ in range(4):                                             # and a few rounds of means
            own = ((x ** 2).sum(1)[:, None] - 2 * x @ centre.T + (centre ** 2).sum(1)).argmin(1)
            centre = np.stack([x[own == p].mean(0) if (own == p).any() else c for p, c in enumerate(centre)])
        return centre

    def distances(self, v: np.ndarray) -> np.ndarray:
        x, c = _same_width(v.astype(np.float64), self.pivots)
        return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in c], 1) if len(c) else np.zeros((len(x), 0))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(v)
        if not d.shape[1]:
            return np.zeros(len(v), np.int64), np.zeros(len(v))
        near = d.argmin(1)
        return near, d[np.arange(len(v)), near]

    def annulus(self, near: np.ndarray, dist: np.ndarray) -> np.ndarray:
        return near * ANNULI + (dist[:, None] > self.edges[near]).sum(1) if len(near) else near

    def set_extents(self, rows) -> None:
        """rows: annulus, least and greatest distance, greatest norm, vectors."""
        self.cell = np.array([r["annulus"] for r in rows], np.int64)
        self.near, self.far = (np.array([r[k] for r in rows], float) for k in ("near", "far"))
        self.norm = np.array([r["norm"] for r in rows], float)
        self.blocks = {r["annulus"]: -(-r["n"] // BLOCK) for r in rows}

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of each query's inner product with any vector of each annulus."""
        x, c = _same_width(q.astype(np.float64), self.pivots)
        own = np.sqrt((x ** 2).sum(1))[:, None]
        pivot = self.cell // ANNULI
        d = self.distances(q)[:, pivot]
        gap = np.maximum(0, np.maximum(d - self.far, self.near - d))    # |q - x| >= gap
        by_gap = (own ** 2 + self.norm ** 2 - gap ** 2) / 2
        by_pivot = (x @ c.T)[:, pivot] + own * self.far                 # q (x - p) <= |q| |x - p|
        bound = np.minimum(by_gap, by_pivot)
        return bound + 1e-9 * (np.abs(bound) + own ** 2 + self.norm ** 2) + 1.0

    def first_score(self, q: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """k-th best score among the fitted vectors, a valid start for the bound."""
        score = inner_products(q, self.sample).astype(np.float64)
        score[ids[:, None] == self.ids[None, :]] = -np.inf
        if score.shape[1] < k:
            return np.full(len(q), -np.inf)
        return -np.partition(-score, k - 1, axis=1)[:, k - 1]


def _expand(queries: DataFrame, shared, k: int, later: bool) -> DataFrame:
    """(query_id, vec, floor, annulus): the annuli each query scans in the first or the later round."""
    def run(batches):
        index = shared.value
        for batch in batches:
            every_id, every = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            known = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            for a in range(0, len(every), 128):
                ids, raw = every_id[a:a + 128], every[a:a + 128]
                q = _matrix(raw)
                bound = index.bounds(q)
                floor = np.fmax(index.first_score(q, ids, k), known[a:a + 128])
                order = np.argsort(-bound, axis=1, kind="stable")
                take = order[:, FIRST:] if later else order[:, :FIRST]
                row, col = np.nonzero(np.take_along_axis(bound, take, 1) >= floor[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row], pa.int64()), pa.array([raw[i] for i in row], pa.binary()),
                     pa.array(floor[row], pa.float64()), pa.array(index.cell[take[row, col]], pa.int64())],
                    names=["query_id", "vec", "floor", "annulus"])

    return queries.mapInArrow(run, "query_id long, vec binary, floor double, annulus long")


def _scan(wanted: DataFrame, blocks: DataFrame, spread: Column, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query chunk in each block, none below the query's floor."""
    wanted = wanted.checkpoint()
    many = {r["annulus"]: -(-r["n"] // CHUNK) for r in
            wanted.groupBy("annulus").agg(F.count("*").alias("n")).collect()}      # at most PIVOTS * ANNULI rows
    if not many:
        return wanted.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    chunk = F.pmod(F.xxhash64("query_id"), _lookup(many, "annulus"))
    chunks = (wanted.groupBy("annulus", chunk.alias("chunk"))
              .agg(F.collect_list(F.struct("query_id", "vec", "floor")).alias("q"))
              .select("annulus", F.col("q.query_id").alias("query_ids"), F.col("q.vec").alias("query_vecs"),
                      F.col("q.floor").alias("floors"), F.explode(F.sequence(F.lit(0), spread - 1)).alias("block")))

    def run(batches):
        for batch in batches:
            for q_ids, q_vecs, floors, ids, vecs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, vecs = np.array(ids, np.int64), _matrix(vecs)
                step = max(1, _MATRIX_CELLS // max(1, len(ids)))
                for a in range(0, len(q_ids), step):
                    own = np.array(q_ids[a:a + step], np.int64)
                    score = inner_products(_matrix(q_vecs[a:a + step]), vecs)
                    good = (score >= np.array(floors[a:a + step])[:, None]) & (own[:, None] != ids[None, :])
                    row, col = np.nonzero(good)
                    value = score[row, col]
                    order = np.lexsort((ids[col], -value, row))
                    row, col, value = row[order], col[order], value[order]
                    head = np.flatnonzero(np.append(True, np.diff(row) > 0)) if len(row) else np.zeros(0, np.int64)
                    place = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))
                    top = place < k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[row[top]], pa.int64()), pa.array(ids[col[top]], pa.int64()),
                         pa.array(value[top], pa.int64())], names=["query_id", "vec_id", "score"])

    met = chunks.join(blocks, ["annulus", "block"]).select("query_ids", "query_vecs", "floors", "ids", "vecs")
    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def _lookup(values: dict[int, int], column: str) -> Column:
    pairs = [x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.col(column))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, k: int, is_query: Column) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates with the highest integer inner product of
    every vector where ``is_query`` (over vec_id) holds; ties to the smaller vec_id.

    Vectors that are null, hold a null or non-finite component or have no id take no part; components a
    shorter vector lacks count as 0.  A query's own id is no candidate of it; other rows that repeat an id
    are candidates one by one, and a repeated query id is answered once.  Fewer candidates than k: all of
    them.  An empty table gives an empty result; other columns are ignored."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    whole = integer_vectors(vectors)
    n = vectors.count()
    rows = (whole.filter(hash_share(F.col("vec_id"), FIT_VECTORS / max(n, 1)))
            .orderBy(F.xxhash64("vec_id"), "vec").limit(2 * FIT_VECTORS).collect())
    index = PivotIndex(_matrix([r["vec"] for r in rows]), np.array([r["vec_id"] for r in rows], np.int64))
    fitted = spark.sparkContext.broadcast(index)            # FIT_VECTORS vectors at most twice

    def key(batches):
        found = fitted.value
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for a in range(0, len(raw), 2048):
                v = _matrix(raw[a:a + 2048])
                near, dist = found.nearest(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 2048), batch.column(1).slice(a, 2048),
                     pa.array(found.annulus(near, dist) if len(found.pivots) else near, pa.int64()),
                     pa.array(dist, pa.float64()),
                     pa.array(np.sqrt((v.astype(np.float64) ** 2).sum(1)), pa.float64())],
                    names=["vec_id", "vec", "annulus", "dist", "norm"])

    keyed = whole.mapInArrow(key, "vec_id long, vec binary, annulus long, dist double, norm double").checkpoint()
    extents = keyed.groupBy("annulus").agg(      # at most PIVOTS * ANNULI rows
        F.min("dist").alias("near"), F.max("dist").alias("far"), F.max("norm").alias("norm"),
        F.count("*").alias("n")).orderBy("annulus").collect()
    if not extents:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index.set_extents(extents)
    shared = spark.sparkContext.broadcast(index)
    spread = _lookup(index.blocks, "annulus")
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), spread).cast("int")
    blocks = (keyed.withColumn("block", block).groupBy("annulus", "block")
              .agg(F.collect_list(F.struct("vec_id", "vec")).alias("v"))      # about BLOCK vectors
              .select("annulus", "block", F.col("v.vec_id").alias("ids"), F.col("v.vec").alias("vecs")).checkpoint())
    queries = (keyed.filter(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
               .select(F.col("vec_id").alias("query_id"), "vec"))
    spread = spread.cast("int")
    nothing = F.lit(float("-inf"))
    first = _best(_scan(_expand(queries.withColumn("known", nothing), shared, k, False), blocks, spread, k), k) \
        .drop("rank").checkpoint()
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
    known = F.when(F.col("n") >= k, F.col("least")).otherwise(nothing)
    rest = queries.join(reached, "query_id", "left").select("query_id", "vec", F.coalesce(known, nothing).alias("known"))
    later = _scan(_expand(rest, shared, k, True), blocks, spread, k)
    return _best(first.unionByName(later), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
