"""A ledger of deliveries, so that a document's chunks always come from one of them.

Chunk ids are made of a document's key and a position.  Two deliveries under one key (a file sent again, a
longer version of it, another file with the same base name) would fill each other's gaps if chunks alone were
compared.  The ledger decides per document: the first delivery of a (collection, doc_key) is admitted, and
what follows is told apart by source and content:

* ``replay``: the admitted source and content again,
* ``changed``: the admitted source with other content (``replaced``, where the caller asks for it: of several
  the last is admitted instead),
* ``collision``: the key from another source.

The ledger is an append-only Parquet table of narrow rows.  A delivery is entered as ``admitted`` before its
chunks are written and as ``stored`` behind it.  After a failure between the two the admitted content (and no
other) is stored when it is delivered again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .partitioning import materialize
from .store import same_keys

DOC = ["collection", "doc_key"]
LEDGER_SCHEMA = ("collection string, doc_key string, source string, content_hash string, delivery string, "
                 "seq long, state string")


def content_hash(text) -> F.Column:
    """What a text is told apart by (null: empty)."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def classify(deliveries: DataFrame, admitted: DataFrame, replace: bool = False) -> DataFrame:
    """``deliveries`` (collection, doc_key, source, content_hash, delivery, row) with ``status``.

    ``admitted`` (collection, doc_key, source, content_hash): one row per known document.  Deliveries of a batch
    are taken by (delivery, source, content_hash, row); null keys and sources are values like others.  One
    aggregate with partial sums and two equi-joins: a key that holds most rows is no single task."""
    order = F.struct("delivery", "source", "content_hash", "row")
    first = deliveries.groupBy(*DOC).agg(F.min(order).alias("first"))
    a, f = admitted.alias("a"), first.alias("f")
    # what each key is held to: the ledger's entry, or the first delivery of the batch
    held = f.join(a, same_keys("f", "a", DOC), "left").select(
        "f.collection", "f.doc_key", F.col("a.content_hash").isNotNull().alias("known"),
        F.coalesce(F.col("a.content_hash"), F.col("f.first.content_hash")).alias("hash"),
        F.when(F.col("a.content_hash").isNotNull(), F.col("a.source")).otherwise(F.col("f.first.source")).alias("from"),
        F.col("f.first.row").alias("first_row"))
    d, h = deliveries.alias("d"), held.alias("h")
    same_source = F.col("d.source").eqNullSafe(F.col("h.from"))
    status = (F.when(~F.col("h.known") & (F.col("d.row") == F.col("h.first_row")), F.lit("new"))
              .when(same_source & (F.col("d.content_hash") == F.col("h.hash")), F.lit("replay"))
              .when(same_source, F.lit("changed")).otherwise(F.lit("collision")))
    out = d.join(h, same_keys("d", "h", DOC)).select("d.*", status.alias("status"))
    if not replace:
        return out
    last = out.where("status = 'changed'").groupBy(*DOC).agg(F.max(order).alias("last"))
    o, x = out.alias("o"), last.alias("x")
    return o.join(x, same_keys("o", "x", DOC), "left").select(
        *[F.col(f"o.{c}") for c in deliveries.columns],
        F.when(F.col("o.row") == F.col("x.last.row"), F.lit("replaced")).otherwise(F.col("o.status")).alias("status"))


class IngestLedger:
    """The ledger table under ``path``, kept between batches and streams."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self) -> DataFrame:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/entries")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self.path}/entries")

    def current(self) -> DataFrame:
        """Per document the admitted source and content, its number and whether it is ``stored``."""
        entry = F.struct("seq", "source", "content_hash")
        per_key = self.read().groupBy(*DOC).agg(
            F.max(F.when(F.col("state") == "admitted", entry)).alias("e"),
            F.max(F.when(F.col("state") == "stored", F.col("seq"))).alias("s"))
        return per_key.select(*DOC, "e.seq", "e.source", "e.content_hash", F.coalesce(F.col("s") == F.col("e.seq"), F.lit(False)).alias("stored"))

    def _append(self, rows: DataFrame) -> None:
        rows.select("collection", "doc_key", "source", "content_hash", "delivery", "seq", "state").write.mode(
            "append").parquet(f"{self.path}/entries")

    def admit(self, docs: DataFrame, replace: bool = False) -> DataFrame:
        """``docs`` (collection, doc_key, source, text, delivery and further columns) with ``status`` and
        ``store``: whether the caller has to write the document's chunks (for ``replaced``, in place of the
        old ones).  The decisions are in the ledger when this returns; the batch is computed once."""
        docs = docs.withColumn("content_hash", content_hash(F.col("text"))).withColumn("delivery", F.col("delivery").cast("string"))
        batch = materialize(docs.withColumn("row", F.monotonically_increasing_id()))
        known = materialize(self.current())
        keys = batch.select(*DOC, "source", "content_hash", "delivery", "row")
        judged = materialize(classify(keys, known.select(*DOC, "source", "content_hash"), replace))
        number = (self.read().agg(F.max("seq")).first()[0] or 0) + 1
        self._append(judged.where(F.col("status").isin("new", "replaced"))
                     .withColumn("seq", F.lit(number).cast("long")).withColumn("state", F.lit("admitted")))
        # a replay of what was admitted but never stored: one row of it is stored now
        lost = known.where(~F.col("stored")).select(*DOC, "content_hash")
        again = judged.where("status = 'replay'").alias("j").join(
            lost.alias("l"), same_keys("j", "l", [*DOC, "content_hash"]), "left_semi").groupBy(*DOC).agg(F.min("row").alias("row"))
        marks = judged.select("row", "status").join(again.select("row", F.lit(True).alias("_again")), "row", "left")
        return materialize(batch.join(marks, "row").withColumn(
            "store", F.col("status").isin("new", "replaced") | F.coalesce("_again", F.lit(False))).drop("_again", "row"))

    def confirm(self, stored: DataFrame) -> None:
        """Enters documents (collection, doc_key) whose chunks are written."""
        now = self.current().alias("n")
        done = stored.select(*DOC).distinct().alias("s").join(now, same_keys("s", "n", DOC)).select("n.*")
        self._append(done.withColumn("delivery", F.lit(None).cast("string")).withColumn("state", F.lit("stored")))


def ingest_documents(docs: DataFrame, store, ledger: IngestLedger, chunk, replace: bool = False, embed=None) -> DataFrame:
    """One delivery batch: ``docs`` are admitted, what is to be stored is packed by ``chunk`` (a function from
    such rows to rows of the chunk table) and written (through ``embed``, if given), and the ledger is told.  Returns the documents without
    their text, with ``status`` and ``chunks``, the number of chunks this delivery has in the store (0: none).

    Chunks of documents that are new go in as they are; those of replaced documents, and of documents whose
    writing was interrupted, take the place of whatever the key has."""
    seen = ledger.admit(docs, replace)
    chunks = materialize(chunk(seen.where("store")))
    fresh = seen.where("store AND status = 'new'").select(*DOC).alias("f")
    is_new = chunks.alias("c").join(fresh, same_keys("c", "f", DOC), "left_semi")
    swapped = chunks.alias("c").join(fresh, same_keys("c", "f", DOC), "left_anti")
    store.add(is_new, embed=embed)
    if not swapped.isEmpty():
        store.add(swapped, replace=True, embed=embed)
    ledger.confirm(seen.where("store"))
    sizes = chunks.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n")).alias("z")
    out = seen.drop("text").alias("s").join(sizes, same_keys("s", "z", DOC), "left")
    return out.select("s.*", F.when(F.col("s.store"), F.coalesce("z.n", F.lit(0))).otherwise(0).cast("long").alias("chunks")).drop(
        "store", "content_hash")
