"""Tables that the query plans derive from the driver fixtures.

documents -> corpus (doc_id = document key, lang = user, source = folder);
benchmark -> questions; embeddings -> stored vectors (label = collection).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collection_name
from ..operators.chunking import CHUNK_SIZE, explode_chunks
from ..operators.embedding import hash_dense
from ..operators.partitioning import spread
from ..operators.store import ChunkStore
from ..sources import tables

# Fixture settings: documents have no blank lines, so the
# fixture queries pack single lines.
FIXTURE_SEP = "\n"
QUESTION_DIM = 64          # = width of the stored vectors in `embeddings`
TEXT_DIM = 256             # hashed width for chunk/question text retrieval
CONTEXT_BUDGET = 8000      # the budget that the context_budget query asks for
TOP_K = 5
SPARSE_TOP_K = 10


def document_name(doc_id) -> F.Column:
    return F.concat(F.lit("doc_"), doc_id.cast("string"))


def doc_chunks(spark, sf_dir) -> DataFrame:
    """C1 + C2 over every document, with the store columns."""
    docs = spread(tables.documents(spark, sf_dir))
    ch = explode_chunks(docs, "doc_id", "text", CHUNK_SIZE, FIXTURE_SEP, keep=["lang", "source"])
    return ch.select(
        collection_name(F.col("lang")).alias("collection"),
        "chunk_id", "doc_id", "chunk_index", "text",
        document_name(F.col("doc_id")).alias("document_name"),
        F.col("source").alias("folder_name"),
        F.lit("file").alias("source_type"),
        F.lit("txt").alias("content_type"),
    )


def questions(spark, sf_dir) -> DataFrame:
    return tables.benchmark(spark, sf_dir).select(F.col("item_id").alias("query_id"),
                                                   F.col("text").alias("query"))


def question_vectors(spark, sf_dir, dim: int = QUESTION_DIM) -> DataFrame:
    """Questions embedded by the bundled hashing provider (unit length)."""
    return hash_dense(questions(spark, sf_dir), "query_id", "query", dim)


def stored_vectors(spark, sf_dir) -> DataFrame:
    e = tables.embeddings(spark, sf_dir)
    return e.select("vec_id", F.col("label").cast("string").alias("collection"), "embedding")


def question_pairs(spark, sf_dir) -> DataFrame:
    """A given pair table: each stored vector with one question, dealt round-robin by id."""
    n = questions(spark, sf_dir).agg(F.max("query_id")).first()[0] + 1
    return stored_vectors(spark, sf_dir).select((F.col("vec_id") % n).alias("query_id"), "vec_id")


def chunk_embeddings(spark, sf_dir, dim: int = QUESTION_DIM) -> DataFrame:
    """Document chunks with the vectors of the bundled provider, as the store keeps them: packed and hashed once,
    in a written table.

    A chunk meets every vector of its id, so an id that comes n times gives n * n rows and a null id none; only
    such ids are joined, and the table is written again with their rows.  ``drop_written`` removes it."""
    from ..operators.partitioning import drop_written, written, written_side

    c = doc_chunks(spark, sf_dir).select("chunk_id", "collection", "text")
    c = written(hash_dense(c, "chunk_id", "text", dim, keep=["collection", "text"]), "chunk-vectors").where("chunk_id IS NOT NULL")
    again = written_side(c.groupBy("chunk_id").count().where("count > 1").select("chunk_id"), "repeated-chunks")
    out = c
    if not again.isEmpty():
        twice = c.join(again, "chunk_id", "left_semi")
        pairs = twice.select("chunk_id", "collection", "text").join(twice.select("chunk_id", "embedding"), "chunk_id")
        out = written(c.join(again, "chunk_id", "left_anti").unionByName(pairs), "chunk-vectors")
        drop_written(c)
    drop_written(again)
    return out


def page_chunks(spark, sf_dir) -> DataFrame:
    """Crawled pages ingested as the reference's URL path does: page text with
    linked content, placeholder, default packing, md5 document key,
    collection ``default``."""
    from ..functions.text import empty_placeholder
    from ..operators import web
    from ..operators.chunking import PARAGRAPH_SEP

    content = web.pages_with_links(web.parsed_pages(tables.pages(spark, sf_dir)))
    content = content.withColumn("text", empty_placeholder(F.col("text"), F.col("url"), kind="url"))
    content = content.withColumn("doc_key", F.md5("url"))
    ch = explode_chunks(content, "doc_key", "text", CHUNK_SIZE, PARAGRAPH_SEP, keep=["url", "domain", "title"])
    return ch.select(
        F.lit("default").alias("collection"), "chunk_id", "doc_key", "chunk_index", "text",
        F.col("title").alias("document_name"), F.lit(None).cast("string").alias("folder_name"),
        F.col("url").alias("source"), F.lit("web").alias("source_type"),
        F.lit("html").alias("content_type"), "domain", "title",
        F.create_map(F.lit("source"), F.col("url"), F.lit("domain"), F.col("domain"), F.lit("title"), F.col("title"),
                     F.lit("content_type"), F.lit("html"), F.lit("source_type"), F.lit("web")).alias("metadata"))


def store_chunks(spark, sf_dir, include_web: bool = True) -> DataFrame:
    """The chunk table (D5): document chunks per user plus web chunks in the
    ``default`` collection.  Jobs scoped to user collections leave the web
    part out, as partition pruning would on the stored table."""
    d = doc_chunks(spark, sf_dir).select(
        "collection", "chunk_id", F.col("doc_id").cast("string").alias("doc_key"), "chunk_index",
        "text", "document_name", "folder_name", F.col("document_name").alias("source"),
        "source_type", "content_type")
    return d.unionByName(page_chunks(spark, sf_dir), allowMissingColumns=True) if include_web else d


_STORES: dict[tuple[str, str], str] = {}  # (application, tables) -> path of the written chunk table


def written_store(spark, sf_dir) -> ChunkStore:
    """The chunk table of these tables as a ``ChunkStore`` in the shared folder, written once per session
    and read by every store job."""
    from ..session import scratch_path

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        path = scratch_path(spark, "chunk-store")
        ChunkStore(spark, path).add(store_chunks(spark, sf_dir))
        _STORES[key] = path
    return ChunkStore(spark, _STORES[key])


def users(spark, sf_dir):
    """The registry (users, folders) of the documents."""
    from ..operators.registry import users_from_documents
    return users_from_documents(tables.documents(spark, sf_dir))


def page_requests(spark, sf_dir) -> DataFrame:
    """(username, folder) requests derived from the crawl: the language
    segment of each page URL asks for a folder named after the page host."""
    from ..operators.web import url_netloc, url_path
    p = tables.pages(spark, sf_dir)
    return p.select(F.regexp_extract(url_path(F.col("url")), "^/([^/]+)", 1).alias("username"),
                    url_netloc(F.col("url")).alias("folder"))


def chat_questions(spark, sf_dir) -> DataFrame:
    """Chat requests over the corpus scopes: per user (no filter), per
    (user, folder), per (user, document), per (user, folder, document), and
    one per user for a folder that does not exist."""
    docs = tables.documents(spark, sf_dir).select(
        F.col("lang").alias("username"), F.col("source").alias("f"),
        document_name(F.col("doc_id")).alias("d"))
    none = F.lit(None).cast("string")
    u = docs.select("username").distinct()
    scopes = [
        u.select(F.concat(F.lit("U:"), "username").alias("query_id"), "username",
                 none.alias("folder_name"), none.alias("document_name")),
        docs.select("username", "f").distinct().select(
            F.concat_ws(":", F.lit("F"), "username", "f").alias("query_id"), "username",
            F.col("f").alias("folder_name"), none.alias("document_name")),
        docs.select(F.concat_ws(":", F.lit("D"), "username", "d").alias("query_id"), "username",
                    none.alias("folder_name"), F.col("d").alias("document_name")),
        docs.select(F.concat_ws(":", F.lit("B"), "username", "f", "d").alias("query_id"), "username",
                    F.col("f").alias("folder_name"), F.col("d").alias("document_name")),
        u.select(F.concat(F.lit("N:"), "username").alias("query_id"), "username",
                 F.concat(F.col("username"), F.lit("_archive")).alias("folder_name"),
                 none.alias("document_name")),
    ]
    out = scopes[0]
    for s in scopes[1:]:
        out = out.unionByName(s)
    return out.withColumn("query", F.concat(F.lit("What do the documents in "),
                                            F.col("query_id"), F.lit(" say?")))
