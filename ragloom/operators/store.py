"""K1-K9: the chunk table and its upkeep jobs.

The store is one Parquet table in hash parts (D5/D6): a fixed number of folders
whatever the number of collections.  A change rewrites the parts it touches as a
new folder and then becomes current; a version being read is never overwritten.
Names meet in null-safe joins, so a null collection is a collection.  The
transforms below are pure DataFrame functions so they can be planned, checked and
tested without touching storage; ``ChunkStore`` applies them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .partitioning import drop_written, materialize, written

KEYS = ["collection", "chunk_id"]
# Parts of the table: a collection is in one bucket, its documents are spread over the bucket's shards.
BUCKETS, SHARDS = 32, 8
# Batch folders a version may have before small ones are merged.
MERGE_AFTER = 12
# The column that tells deliveries of one document apart (lowest first), where a batch has it.
ORDER_COL = "ingest_seq"

CHUNK_SCHEMA = T.StructType([
    T.StructField("collection", T.StringType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("doc_key", T.StringType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("document_name", T.StringType()),
    T.StructField("folder_name", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])


def conform(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Columns of the chunk table in order; absent ones (e.g. ``embedding``
    before the embed step) become typed nulls.  ``extra``: further columns to keep, where present."""
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA.fields],
                     *[c for c in extra if c in df.columns])


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of the key columns of two aliased frames."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among the others' (null keys are equal)."""
    return rows.alias("r").join(others.select(*keys).alias("o"), same_keys("r", "o", keys), "left_anti")


def among(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are among the others' (null keys are equal)."""
    return rows.alias("r").join(others.select(*keys).alias("o"), same_keys("r", "o", keys), "left_semi")


def first_write_wins(batch: DataFrame, order_col: str = ORDER_COL) -> DataFrame:
    """One row per (collection, chunk_id), all chunks of a document from one delivery.

    The first delivery of a (collection, doc_key) wins whole: the one with the lowest (``order_col`` when
    given, ``source``).  Its other deliveries are dropped before chunks are compared, so chunks of two files
    with one key never mix, whatever the layout.  Two deliveries with one source need ``order_col`` to be told
    apart; without it the row of the smallest content hash is taken of each chunk."""
    return one_row(one_delivery(batch, order_col))


def one_delivery(batch: DataFrame, order_col: str = ORDER_COL) -> DataFrame:
    """The rows of each document's first delivery."""
    doc = ["collection", "doc_key"] if "doc_key" in batch.columns else KEYS
    order = F.struct(*[F.col(c) for c in (order_col, "source") if c in batch.columns], F.lit(0).alias("_z"))
    batch = batch.withColumn("_order", order)
    first = batch.groupBy(*doc).agg(F.min("_order").alias("_first"))
    return (batch.alias("b").join(first.alias("f"), same_keys("b", "f", doc) & (F.col("b._order") == F.col("f._first")))
            .select("b.*").drop("_order", order_col))


def one_row(kept: DataFrame) -> DataFrame:
    """One row per (collection, chunk_id): that of the smallest content hash."""
    rest = [c for c in kept.columns if c not in KEYS]
    content = F.xxhash64(F.to_json(F.struct(*rest)) if rest else F.lit(0))
    picked = kept.groupBy(*KEYS).agg(F.min_by(F.struct(*rest, F.lit(0).alias("_z")), content).alias("_row"))
    return picked.select(*[F.col(c) if c in KEYS else F.col(f"_row.{c}").alias(c) for c in kept.columns])


def numbered_rows(batch: DataFrame) -> DataFrame:
    """``batch`` with a number (``_row``, to be written before it is read) and the content hash of ``one_row`` for
    every row, so rows can be chosen by their keys alone."""
    rest = [f.name for f in CHUNK_SCHEMA.fields if f.name not in KEYS]
    return batch.withColumns({"_content": F.xxhash64(F.to_json(F.struct(*rest))), "_row": F.monotonically_increasing_id()})


def chosen_rows(batch: DataFrame, candidates: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(rows, written tables that they read beside ``batch``): rows of a written, numbered batch: of each (collection, chunk_id) in ``candidates`` (KEYS, ``_content``, ``_row``)
    the one of the smallest content hash.

    Keys and numbers are compared; the texts pass only a semi- or anti-join with the shorter list of numbers, which
    is broadcast when it is small, so they need not be shuffled or sorted before the layout."""
    best = candidates.groupBy(*KEYS).agg(F.min(F.struct("_content", "_row")).alias("_best"))
    won = written(best.select("_best._row"), "store-won")
    n, total = won.count(), batch.count()
    if n == total:
        return batch, [won]
    if 2 * n < total:
        return batch.join(won, "_row", "left_semi"), [won]
    lost = written(batch.select("_row").join(won, "_row", "left_anti"), "store-lost")
    return batch.join(lost, "_row", "left_anti"), [won, lost]


def add_if_absent(existing: DataFrame, new: DataFrame, order_col: str = ORDER_COL) -> DataFrame:
    """K1: rows of ``new`` whose (collection, chunk_id) is not stored yet
    (first write wins, also inside the batch), appended to ``existing``."""
    fresh = without(first_write_wins(new, order_col), existing, KEYS)
    return existing.unionByName(fresh.select(*existing.columns))


def replace_documents(existing: DataFrame, new: DataFrame, order_col: str = ORDER_COL) -> DataFrame:
    """Q10 ``replace``: every stored chunk of a (collection, doc_key) present
    in ``new`` is dropped first, so a shorter re-ingest leaves no stale tail
    chunks; then the new chunks are added (first write wins inside the batch)."""
    kept = without(existing, new.select("collection", "doc_key").distinct(), ["collection", "doc_key"])
    fresh = first_write_wins(new, order_col)
    return kept.unionByName(fresh.select(*existing.columns))


def delete_by_ids(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """K9: remove exactly the listed (collection, chunk_id) rows."""
    return without(existing, ids.select(*KEYS).distinct(), KEYS)


def clear_collections(existing: DataFrame, requests: DataFrame, name_col: str = "collection",
                      emptied: DataFrame | None = None) -> DataFrame:
    """K8 result rows: per requested collection, whether it existed, how many
    chunks were deleted, and the status (False when missing, else True).
    ``emptied`` (collection): collections that exist without chunks."""
    req = requests.select(F.col(name_col).alias("collection")).distinct()
    # per-collection counts need only the partition column of the table
    counts = existing.groupBy("collection").agg(F.count(F.lit(1)).alias("_n"))
    if emptied is not None:
        counts = counts.unionByName(emptied.select("collection", F.lit(0).cast("bigint").alias("_n"))) \
            .groupBy("collection").agg(F.max("_n").alias("_n"))
    r = req.alias("r").join(counts.alias("c"), same_keys("r", "c", ["collection"]), "left")
    return r.select("r.collection",
                    F.col("_n").isNotNull().alias("existed"),
                    F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("deleted"),
                    F.col("_n").isNotNull().alias("status"))


def list_collections(chunks: DataFrame) -> DataFrame:
    """K4."""
    return chunks.select("collection").distinct()


def collection_counts(chunks: DataFrame) -> DataFrame:
    """K5 + K6: chunk count per collection and the result limit (>= 1)."""
    return (chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("result_limit", F.greatest(F.lit(1).cast("bigint"), F.col("n"))))


def inventory(chunks: DataFrame) -> DataFrame:
    """K7: id, document name and folder with the listing defaults."""
    return chunks.select("collection", "chunk_id",
                         F.coalesce("document_name", F.lit("Unknown")).alias("document_name"),
                         F.coalesce("folder_name", F.lit("No folder")).alias("folder_name"))


class ChunkStore:
    """Versioned chunk table in hash parts on shared storage.

    Layout under ``path``:

    * ``data/bNNNNNN/part=P/*.parquet`` - immutable batch folders.  ``P`` is the collection's bucket and the
      document's shard, so a table has at most ``buckets * shards`` parts, and what belongs to one document is
      in one of them.  Files are ordered by collection, document and position.
    * ``names/nNNNNNN`` - collections that were cleared (they exist without chunks)
    * ``_versions/vNNNNNN.json`` - a manifest per version: a line with the layout, one per batch folder with
      the parts that later folders replaced, one per names folder

    A version becomes visible only when its manifest is written, after its data is complete, so readers never
    see a partial write and a version being read is never changed.  Inserts write only new rows.  Deletes, clears
    and replacements find the parts they touch by a semi-join on the key columns and rewrite only those; at most
    the numbers of the parts reach the driver, never names.  Small folders are merged as they pile up.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, shards: int = SHARDS):
        self.spark = spark
        self.path = path.rstrip("/")
        entries = self._manifest()
        layout = entries[0]["layout"] if entries else [buckets, shards]      # an existing table keeps its own
        self.buckets, self.shards = layout

    # ------------------------------------------------------------ manifests
    def _jpath(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        p = self._jpath(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, sub: str, prefix: str) -> list[int]:
        fs, _ = self._fs()
        d = self._jpath(f"{self.path}/{sub}")
        if not fs.exists(d):
            return []
        out = []
        for st in fs.listStatus(d):
            name = st.getPath().getName().split(".")[0]
            if name.startswith(prefix) and name[1:].isdigit():
                out.append(int(name[1:]))
        return sorted(out)

    def versions(self) -> list[int]:
        """Committed versions (manifests written after complete data)."""
        return self._numbers("_versions", "v")

    def _manifest(self, version: int | None = None) -> list[dict]:
        import json

        v = self.versions()
        if not v:
            return []
        n = v[-1] if version is None else version
        fs, _ = self._fs()
        stream = fs.open(self._jpath(f"{self.path}/_versions/v{n:06d}.json"))
        try:
            reader = self.spark._jvm.java.io.BufferedReader(
                self.spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            lines = []
            line = reader.readLine()
            while line is not None:
                if line.strip():
                    lines.append(json.loads(line))
                line = reader.readLine()
            return lines
        finally:
            stream.close()

    def _next_number(self) -> int:
        used = self.versions() + self._numbers("data", "b") + self._numbers("names", "n")
        return (max(used) + 1) if used else 1

    def _publish(self, n: int, entries: list[dict]) -> None:
        import json

        fs, _ = self._fs()
        if not fs.createNewFile(self._jpath(f"{self.path}/_versions/.v{n:06d}.claim")):
            raise RuntimeError(f"version {n} was published concurrently")
        lines = [{"layout": [self.buckets, self.shards]}, *(e for e in entries if "layout" not in e)]
        body = "".join(json.dumps(e, sort_keys=True) + "\n" for e in lines)
        tmp = self._jpath(f"{self.path}/_versions/.v{n:06d}.json.tmp")
        out = fs.create(tmp, False)
        try:
            out.write(bytearray(body.encode("utf-8")))
        finally:
            out.close()
        if not fs.rename(tmp, self._jpath(f"{self.path}/_versions/v{n:06d}.json")):
            raise RuntimeError(f"version {n} was published concurrently")

    # ------------------------------------------------------------ layout
    def _part(self, collection: Column | str = "collection", doc_key: Column | str = "doc_key") -> Column:
        bucket = F.pmod(F.xxhash64(collection), F.lit(self.buckets))
        return (bucket * self.shards + F.pmod(F.xxhash64(doc_key), F.lit(self.shards))).cast("int")

    def _parts(self, df: DataFrame) -> list[int]:
        """Parts of the rows of ``df`` (column ``part``): at most ``buckets * shards`` numbers."""
        return sorted(r[0] for r in df.select("part").distinct().collect())

    def _write_batch(self, df: DataFrame, n: int, embed=None) -> dict:
        """Writes rows as batch folder ``n``; the manifest line with the number of rows, counted as they pass."""
        folder, counted = f"b{n:06d}", Observation()
        order = ["part", "collection", "doc_key", "chunk_index"]
        rows = conform(df).withColumn("part", self._part()).repartitionByRange(*order)
        if embed is not None:           # behind the range sample: once per chunk
            rows = conform(embed(rows.drop("embedding", "part"))).withColumn("part", self._part())
        rows = rows.sortWithinPartitions(*order).observe(counted, F.count(F.lit(1)).alias("rows"))
        rows.write.mode("error").partitionBy("part").parquet(f"{self.path}/data/{folder}")
        return {"folder": folder, "hidden": [], "rows": int(counted.get["rows"])}

    # ------------------------------------------------------------ reads
    def _read_entries(self, entries: list[dict], parts: list[int] | None = None) -> DataFrame:
        """Visible rows of the folders, with their ``part``; with ``parts`` only those (pruned at the scan)."""
        schema = T.StructType([*CHUNK_SCHEMA.fields, T.StructField("part", T.IntegerType())])
        frames = []
        for e in entries:
            if not e.get("rows"):
                continue
            df = self.spark.read.schema(schema).parquet(f"{self.path}/data/{e['folder']}")
            shown = None if parts is None else sorted(set(parts) - set(e["hidden"]))
            if shown is not None:
                df = df.where(F.col("part").isin(shown))
            elif e["hidden"]:
                df = df.where(~F.col("part").isin(e["hidden"]))
            frames.append(df)
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """K2: the chunk table at a version (latest by default); a missing
        table reads as an empty DataFrame with the schema."""
        return self._read_entries(self._manifest(version)).drop("part")

    def read_collection(self, collection: str | None, version: int | None = None) -> DataFrame:
        """The chunks of one collection (null: those without one): only its bucket's parts are scanned."""
        name = F.lit(collection).cast("string")
        rows = self._read_entries(self._manifest(version))
        first = F.pmod(F.xxhash64(name), F.lit(self.buckets)) * self.shards
        return rows.where((F.col("part") >= first) & (F.col("part") < first + self.shards)
                          & F.col("collection").eqNullSafe(name)).drop("part")

    # ------------------------------------------------------------ writes
    def add(self, new: DataFrame, replace: bool = False, embed=None) -> int:
        """K1 insert-if-absent: only rows whose (collection, chunk_id) is not
        stored are written, as a new batch folder.  With ``replace`` the
        stored chunks of the incoming documents are dropped first (only the
        parts of the batch are rewritten).  ``embed`` adds the embedding
        column to the rows that are new, after the stored ones are left out, so
        a chunk is embedded once and a replay embeds nothing.  A column
        ``ingest_seq`` tells deliveries of one document apart.  The batch is
        computed once.  Returns the rows written."""
        entries = self._manifest()
        batch = written(numbered_rows(conform(new, (ORDER_COL,)).withColumn("part", self._part())), "store-batch")
        current = self._read_entries(entries, self._parts(batch))
        first = one_delivery(batch.select(*KEYS, "doc_key", "source", "_content", "_row",
                                          *(c for c in (ORDER_COL,) if c in batch.columns)))
        n = self._next_number()
        if replace:
            docs = batch.select("collection", "doc_key").distinct()
            kept = without(current, docs, ["collection", "doc_key"])
            entries = self._replaced(entries, self._parts(batch), kept, n)
            n += 1
        elif entries:
            first = without(first, current, KEYS)
        rows, numbers = chosen_rows(batch, first)
        added = self._write_batch(rows, n, embed)
        if added["rows"] or replace:
            self._publish(n, [*entries, added])
            self._merge()
        for table in (batch, *numbers):
            drop_written(table)
        return added["rows"]

    def _replaced(self, entries: list[dict], parts: list[int], rows: DataFrame, n: int) -> list[dict]:
        """Entries of a version whose ``parts`` hold ``rows`` (written as folder ``n``)."""
        hide = [dict(e, hidden=sorted({*e["hidden"], *parts})) if "folder" in e else e for e in entries]
        return [*hide, self._write_batch(rows, n)]

    def _drop(self, gone: DataFrame, keys: list[str]) -> list[dict]:
        """Entries of a version without the rows whose ``keys`` are in ``gone``; data of touched parts is rewritten."""
        entries = self._manifest()
        held = self._read_entries(entries).select("part", *keys)            # a scan of the key columns
        parts = self._parts(among(held, gone, keys))
        if not parts:
            return entries
        rows = without(self._read_entries(entries, parts), gone, keys)
        return self._replaced(entries, parts, rows, self._next_number())

    def delete_ids(self, ids: DataFrame) -> None:
        """K9: rewrite only the parts that hold listed ids."""
        entries = self._drop(materialize(ids.select(*KEYS).distinct()), KEYS)
        self._publish(self._next_number(), entries)
        self._merge()

    def emptied(self) -> DataFrame:
        """Collections that were cleared: they exist without chunks until something is added."""
        folders = [f"{self.path}/names/{e['names']}" for e in self._manifest() if "names" in e]
        if not folders:
            return self.spark.createDataFrame([], "collection string")
        return self.spark.read.schema("collection string").parquet(*folders).distinct()

    def clear(self, collections: list[str | None] | DataFrame) -> DataFrame:
        """K8: result rows (from a list of names or a DataFrame with ``collection``), after a new version
        without the chunks of these collections."""
        if not isinstance(collections, DataFrame):
            collections = self.spark.createDataFrame([(c,) for c in collections], "collection string")
        result = materialize(clear_collections(self.read(), collections, emptied=self.emptied()))
        known = result.where("existed").select("collection")
        entries = self._drop(known, ["collection"])
        n = self._next_number()
        known.write.mode("error").parquet(f"{self.path}/names/n{n:06d}")
        self._publish(n, [*entries, {"names": f"n{n:06d}"}])
        self._merge()
        return result

    def _merge(self) -> None:
        """Keeps the number of folders small: once there are more than ``MERGE_AFTER``, all behind the largest are
        merged into one, or all folders, if those hold as many rows as the largest."""
        folders = [e for e in self._manifest() if "folder" in e]
        if len(folders) <= MERGE_AFTER:
            return
        largest = max(folders, key=lambda e: e["rows"])
        others = [e for e in folders if e is not largest]
        self._merged(folders if sum(e["rows"] for e in others) >= largest["rows"] else others)

    def _merged(self, folders: list[dict]) -> None:
        entries = self._manifest()
        n = self._next_number()
        merged = self._write_batch(self._read_entries(folders), n)
        names = {e["folder"] for e in folders}
        self._publish(n, [*(e for e in entries if e.get("folder") not in names), merged])

    def compact(self) -> None:
        """Merge every visible row into one batch folder (drops hidden data
        from the current version; older versions keep their folders)."""
        self._merged([e for e in self._manifest() if "folder" in e])
