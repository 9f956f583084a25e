"""Incremental ingest and the question stream as Structured Streaming.

* ``start_file_ingest``: new files in a folder -> extract -> chunk ->
  insert-if-absent into the chunk store, one ``foreachBatch`` per
  micro-batch.  Ids are deterministic and the write is insert-if-absent, so
  a replayed micro-batch (after a failure) or a file delivered twice adds
  nothing (T3) - no state store and no watermark are needed.
* ``start_question_stream``: questions arriving as files are answered
  against the static chunk table with the scoped-context job; each
  micro-batch writes its own ``epoch=N`` folder, so a replay overwrites the
  same output instead of duplicating it.

Each stream keeps its progress in the checkpoint folder its caller names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import file_key
from ..operators.ledger import IngestLedger, ingest_documents
from ..operators.store import ChunkStore
from ..sources.corpus import stream_corpus_files
from ..sources.files import BINARY_FILE_SCHEMA, chunk_files, extract_files

QUESTION_SCHEMA = "query_id string, username string, folder_name string, document_name string, query string"


def ingest_files(files: DataFrame, store: ChunkStore, collection: str = "default",
                 metadata: dict | None = None, provider=None, dim: int = 768,
                 input_cap: int | None = None, ledger: IngestLedger | None = None,
                 delivery: str = "") -> DataFrame:
    """Path A as one batch job: extract -> chunk -> insert-if-absent, new chunks
    embedded by ``provider`` as they are written.  Returns the per-file receipts.
    The chunks are checkpointed, so nothing is extracted or packed twice.

    With ``ledger`` each file goes through it under ``delivery``: of files with one document key only the
    admitted one is stored, and the receipts say what each was (``delivery_status``)."""
    from ..operators.embedding import embed
    from ..operators.partitioning import materialize
    from ..sources.files import ingest_receipts

    extracted = materialize(extract_files(files))
    adding = None if provider is None else (lambda rows: embed(rows, provider, dim=dim, input_cap=input_cap))
    if ledger is not None:
        docs = extracted.where("extract_status = 'ok'").select(
            "*", F.lit(collection).alias("collection"), file_key(F.col("path")).alias("doc_key"),
            F.col("path").alias("source"), F.lit(delivery).alias("delivery"))
        got = ingest_documents(docs, store, ledger, lambda d: chunk_files(d, collection, metadata), embed=adding)
        seen = got.select("path", "chunks", F.col("status").alias("delivery_status"))
        return extracted.join(seen, "path", "left").select(
            "path", F.when(F.col("extract_status") == "ok", F.lit("success")).otherwise(F.lit("error")).alias("status"),
            F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"),
            F.when(F.col("extract_status") != "ok", F.col("extract_status")).alias("error"), "delivery_status")
    chunks = materialize(chunk_files(extracted, collection, metadata))
    store.add(chunks, embed=adding)
    return ingest_receipts(extracted, chunks)


def start_file_ingest(spark: SparkSession, source_dir: str, store: ChunkStore, checkpoint: str,
                      collection: str = "default", metadata: dict | None = None, available_now: bool = True,
                      glob: str | None = None, receipts_path: str | None = None,
                      provider=None, dim: int = 768, input_cap: int | None = None,
                      max_files_per_trigger: int = 1000, ledger: IngestLedger | None = None,
                      every_file: bool = False) -> StreamingQuery:
    """T1 + T3: with ``every_file`` the files come from the corpus source, which lists zero-length ones too and
    runs until it is stopped; with ``ledger`` deliveries of one document are told apart.  Each micro-batch holds at most ``max_files_per_trigger`` new
    files (a backlog becomes several bounded batches, also with
    ``availableNow``) and goes through ``ingest_files``.  ``checkpoint`` names
    the stream's own shared folder, so a restart goes on where it stopped."""
    if every_file:
        stream = stream_corpus_files(spark, source_dir, maxFilesPerTrigger=str(max_files_per_trigger),
                                     **({"glob": glob} if glob else {}))
        available_now = False
    else:
        reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
                  .option("maxFilesPerTrigger", max_files_per_trigger))
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        stream = reader.option("recursiveFileLookup", "true").load(source_dir)

    def handle(batch: DataFrame, epoch_id: int) -> None:
        receipts = ingest_files(batch, store, collection, metadata, provider, dim, input_cap, ledger, str(epoch_id))
        if receipts_path:
            (receipts.withColumn("epoch", F.lit(epoch_id))
             .write.mode("overwrite").parquet(f"{receipts_path}/epoch={epoch_id}"))

    w = stream.writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_question_stream(spark: SparkSession, source_dir: str, store: ChunkStore, out_path: str,
                          checkpoint: str, budget: int, available_now: bool = True,
                          max_files_per_trigger: int = 100) -> StreamingQuery:
    """Question files -> scoped prompts of at most ``budget`` characters of context against the current
    chunk table, one ``epoch=N`` output folder per micro-batch.  ``checkpoint`` names the stream's own shared
    folder, so a restart goes on where it stopped."""
    from ..operators.prompts import assemble_prompts
    from ..workflows import chat

    stream = (spark.readStream.schema(QUESTION_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger).json(source_dir))

    def handle(batch: DataFrame, epoch_id: int) -> None:
        (assemble_prompts(chat(store.read(), batch), budget)
         .write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}"))

    w = stream.writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
