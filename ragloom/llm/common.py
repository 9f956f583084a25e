"""Helpers shared by the operators: table readers, Arrow row blocks, hash folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 * 1024 * 1024  # text handed to one numpy call; bounds a worker's arrays, never the rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows whose texts hold about ``limit`` characters together
    (a longer text forms a range of its own)."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if len(texts) > a:
        yield a, len(texts)


def text_blocks(*columns: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[list]]]:
    """(a, b, texts of each column) of ranges [a, b) of rows whose texts hold about ``limit`` bytes together: only
    one range's texts are Python objects at a time."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in columns)
    a = held = 0
    for i, n in enumerate(size.tolist()):
        if i > a and held + n > limit:
            yield a, i, [c.slice(a, i - a).to_pylist() for c in columns]
            a, held = i, 0
        held += n
    if len(size) > a:
        yield a, len(size), [c.slice(a).to_pylist() for c in columns]


_KEPT: dict = {}     # per worker process


def _let_go() -> None:
    if _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()


def kept(key, make: Callable):
    """What ``make`` built for ``key`` in this worker process.  One at a time, and until ``map_text`` runs something
    else here: workers are used again, and what one operator remembers is no use to the next."""
    if key not in _KEPT:
        _let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def map_text(df: DataFrame, keep: list[str], text: str, schema: str,
             make: Callable[[], Callable[[list], dict[str, pa.Array]]], limit: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns plus what a per-block function computes from the text column.

    ``text`` may be a field ``column.field`` of a kept struct column: then it is sent once, not twice.
    ``make()`` runs once per task and returns the block function: a list of texts (None for null) of about ``limit``
    bytes in, one Arrow array per output column out, row for row."""
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    out_schema = f"{fields}, {schema}" if keep else schema
    n_keep = len(keep)
    whole, _, field = text.partition(".")
    at = keep.index(whole) if field else n_keep

    def run(batches):
        _let_go()
        fn = make()
        for batch in batches:
            column = pc.struct_field(batch.column(at), field) if field else batch.column(at)
            for a, b, (texts,) in text_blocks(column, limit=limit):
                got = fn(texts)
                cols = [batch.column(i).slice(a, b - a) for i in range(n_keep)]
                yield pa.RecordBatch.from_arrays(
                    cols + list(got.values()), names=list(keep) + list(got))

    sent = [F.col(k) for k in keep] + ([] if field else [F.col(text).alias("__text")])
    return df.select(*sent).mapInArrow(run, out_schema)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def hash_share(key: Column, share: float) -> Column:
    """True for about ``share`` of the distinct keys, chosen by hash."""
    grid = 1 << 30
    return F.pmod(F.xxhash64(key), F.lit(grid)) < F.lit(int(min(1.0, share) * grid))


def carried(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs`` as one struct, so none can clash with an operator's own), doc_id, content
    (hash of the text)."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"),
                       F.xxhash64(f"`{text}`").alias("content"))


def one_of_each(rows: DataFrame, *keep: str) -> DataFrame:
    """Of ``carried`` rows that repeat an id and a text one, the same on every run: that of the smallest hash."""
    return rows.groupBy("doc_id", "content").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"),
                                                 *(F.min(k).alias(k) for k in keep))
