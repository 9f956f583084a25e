"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each reads whole driver tables (or tables Spark derives from them); column
names match the DuckDB statements in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collection_name
from ..functions.vectors import fit_dimension, l2_normalize
from ..operators import chunking, embedding, lexical, retrieval
from ..sources import tables
from . import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ chunking
@query
def chunk_documents(spark, sf):
    c = D.doc_chunks(spark, sf)
    return c.select("doc_id", "chunk_index", "text")


@query
def chunk_ids(spark, sf):
    return D.doc_chunks(spark, sf).select("doc_id", "chunk_index", "chunk_id")


@query
def chunk_stats(spark, sf):
    return chunking.chunk_stats(D.doc_chunks(spark, sf), "doc_id")


# ------------------------------------------------------------------ embeddings
@query
def embed_input(spark, sf):
    d = embedding.embed_input(tables.documents(spark, sf), "text")
    return d.select("doc_id", "piece", F.length("embed_text").cast("bigint").alias("input_chars"),
                    F.md5("embed_text").alias("input_md5"))


@query
def hash_embedding(spark, sf):
    s = embedding.hash_sparse(tables.documents(spark, sf), "doc_id", "text", D.TEXT_DIM)
    return s.select("doc_id", "bucket", r6(F.col("weight")).alias("weight"))


def _explode_vec(df, key, vec):
    return df.select(key, F.posexplode(vec).alias("pos", "value")).select(
        key, F.col("pos").cast("bigint").alias("pos"), r6(F.col("value")).alias("value"))


@query
def embedding_fit(spark, sf):
    e = tables.embeddings(spark, sf)
    parts = [_explode_vec(e.select("vec_id", fit_dimension(F.col("embedding"), d).alias("v")),
                          "vec_id", "v").withColumn("dim", F.lit(d).cast("bigint"))
             for d in (32, 100)]
    return parts[0].unionByName(parts[1])


@query
def embedding_normalize(spark, sf):
    e = tables.embeddings(spark, sf)
    return _explode_vec(e.select("vec_id", l2_normalize(F.col("embedding")).alias("v")),
                        "vec_id", "v")


# ------------------------------------------------------------------ dense retrieval
def _hits(df, id_col="vec_id"):
    return df.select("query_id", id_col, "collection", r6(F.col("distance")).alias("distance"),
                     r6(F.col("similarity")).alias("similarity"), *[c for c in ["rank"] if c in df.columns])


def _scored_pairs(spark, sf):
    return retrieval.score_pairs(D.stored_vectors(spark, sf), D.question_vectors(spark, sf),
                                 D.question_pairs(spark, sf))


@query
def pairwise_distance(spark, sf):
    return _hits(_scored_pairs(spark, sf))


@query
def rank_all(spark, sf):
    return _hits(retrieval.rank_all(_scored_pairs(spark, sf)))


@query
def topk(spark, sf):
    return _hits(retrieval.topk(D.stored_vectors(spark, sf), D.question_vectors(spark, sf), D.TOP_K))


@query
def store_topk(spark, sf):
    """Dense ranking of the chunk table by its stored vectors: string ids, the text carried.  The hits are written,
    so texts are not shuffled, and the scratch tables are removed."""
    from ..operators.partitioning import drop_written, materialize, written_side
    c = D.chunk_embeddings(spark, sf)
    best = retrieval.topk(c, D.question_vectors(spark, sf), D.TOP_K, id_col="chunk_id")
    best = written_side(_hits(best, "chunk_id"), "store-hits")
    hits = materialize(best.join(c.select("chunk_id", "text"), "chunk_id"))
    drop_written(best)
    drop_written(c)
    return hits


# ------------------------------------------------------------------ sparse retrieval
@query
def rank_sparse(spark, sf):
    r = retrieval.rank_sparse(D.doc_chunks(spark, sf), D.questions(spark, sf), D.SPARSE_TOP_K)
    return r.select("query_id", "rank", "chunk_id", r6(F.col("score")).alias("score"))


def _hits_in_budget(spark, sf):
    return lexical.lexical_hits(D.doc_chunks(spark, sf), D.questions(spark, sf), budget=D.CONTEXT_BUDGET)


@query
def context_budget(spark, sf):
    return retrieval.budget_rows(_hits_in_budget(spark, sf), D.CONTEXT_BUDGET)


def _context(spark, sf, hits):
    rows = retrieval.ranked_rows(hits, D.doc_chunks(spark, sf), D.CONTEXT_BUDGET)
    return retrieval.ordered_concat(rows, ["query_id"], "rank")


@query
def ranked_context(spark, sf):
    return _context(spark, sf, _hits_in_budget(spark, sf))


@query
def ranked_prompt(spark, sf):
    from ..operators.partitioning import materialize
    from ..operators.prompts import ranked_prompts
    hits = materialize(_hits_in_budget(spark, sf))
    return ranked_prompts(D.questions(spark, sf), retrieval.with_empty_contexts(hits, _context(spark, sf, hits)))


# ------------------------------------------------------------------ web pages
def _parsed(spark, sf):
    from ..operators import web
    return web.parsed_pages(tables.pages(spark, sf))


@query
def pages_scan(spark, sf):
    p = tables.pages(spark, sf)
    return p.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query
def url_domain(spark, sf):
    from ..operators.web import url_netloc
    return tables.pages(spark, sf).select("page_id", url_netloc(F.col("url")).alias("domain"))


@query
def url_key(spark, sf):
    return tables.pages(spark, sf).select("page_id", "url", chunking.url_key(F.col("url")).alias("key"))


@query
def html_title(spark, sf):
    return _parsed(spark, sf).select("page_id", "title")


@query
def html_to_text(spark, sf):
    return _parsed(spark, sf).select("page_id", "text")


@query
def page_links(spark, sf):
    from ..operators import web
    return web.page_links(_parsed(spark, sf))


@query
def page_links_capped(spark, sf):
    from ..operators import web
    return web.page_links(_parsed(spark, sf), web.MAX_LINKS_SINGLE)


@query
def page_metadata(spark, sf):
    from ..operators import web
    return web.page_metadata(_parsed(spark, sf)).drop("metadata")


@query
def linked_content(spark, sf):
    from ..operators import web
    return web.linked_content(_parsed(spark, sf))


@query
def page_with_links(spark, sf):
    from ..operators import web
    return web.pages_with_links(_parsed(spark, sf)).select(
        "page_id", "text", "includes_linked_content", "linked_pages_count")


def _sitemap(spark, sf):
    from ..operators import web
    from ..operators.partitioning import materialize
    parsed = materialize(_parsed(spark, sf))
    return parsed, web.host_successor_links(tables.pages(spark, sf))


@query
def sitemap_linked_content(spark, sf):
    """J1 over the derived host-successor edges (no fixture link resolves)."""
    from ..operators import web
    parsed, links = _sitemap(spark, sf)
    return web.linked_content(parsed, links=links)


@query
def sitemap_page_with_links(spark, sf):
    """J2 over the derived host-successor edges."""
    from ..operators import web
    parsed, links = _sitemap(spark, sf)
    return web.pages_with_links(parsed, materialized=True, links=links).select(
        "page_id", "text", "includes_linked_content", "linked_pages_count")


@query
def url_batch_status(spark, sf):
    """Batch request = every crawled URL plus every kept link URL."""
    from ..operators import web
    from ..operators.partitioning import materialize
    parsed = materialize(_parsed(spark, sf))
    urls = parsed.select("url").unionByName(web.page_links(parsed).select("url")).distinct()
    return web.url_batch(urls, parsed, materialized=True).select(
        "url", "status", "document_id", "chunks", "error")


# ------------------------------------------------------------------ text rules
@query
def empty_placeholder(spark, sf):
    from ..functions.text import empty_placeholder as ph
    d = tables.documents(spark, sf)
    name = F.concat(D.document_name(F.col("doc_id")), F.lit(".txt"))
    # the tables hold no blank text, so every tenth is blanked in one of three ways
    blank = (F.when(F.col("doc_id") % 30 == 0, F.lit("")).when(F.col("doc_id") % 30 == 10, F.lit(" \n\t"))
             .when(F.col("doc_id") % 30 == 20, F.lit(None).cast("string")).otherwise(F.col("text")))
    return d.withColumn("text", blank).select("doc_id", ph(F.col("text"), name, kind="file").alias("text"))


@query
def collection_names(spark, sf):
    from ..functions.text import collection_name, display_name
    langs = tables.documents(spark, sf).select("lang").distinct()
    return langs.select("lang", collection_name(F.col("lang")).alias("collection"),
                        display_name(collection_name(F.col("lang"))).alias("display_name"))


@query
def question_filter(spark, sf):
    from ..functions.text import is_blank
    c = tables.conversations(spark, sf)
    return c.where((F.col("role") == "user") & ~is_blank(F.col("text"))).select("conv_id", "turn", "text")


@query
def train_clean_distinct(spark, sf):
    from ..operators.trainset import clean_distinct
    return clean_distinct(tables.documents(spark, sf))


@query
def train_pairs(spark, sf):
    from ..operators.trainset import pair_turns, split_pairs
    pairs, _ = split_pairs(pair_turns(tables.conversations(spark, sf)))
    return pairs.select("conv_id", "turn", "question", "answer")


@query
def dedup_infer(spark, sf):
    from ..operators.prompts import infer, text_length_fn
    c = tables.conversations(spark, sf).select("conv_id", "turn", "text")
    return infer(c, text_length_fn, input_col="text", out_col="output").select(
        "conv_id", "turn", "output")


@query
def memo_infer(spark, sf):
    """J7 between jobs: one job over the users' turns, then one over all turns that computes what is left."""
    from ..operators.memo import InferenceMemo
    from ..operators.prompts import text_length_fn
    from ..session import scratch_path
    c = tables.conversations(spark, sf).select("conv_id", "turn", "role", "text")
    memo = InferenceMemo(spark, scratch_path(spark, "memo"))
    memo.infer(c.where("role = 'user'"), text_length_fn, "length", "text", "output")
    return memo.infer(c, text_length_fn, "length", "text", "output", "computed").select(
        "conv_id", "turn", "output", "computed")


@query
def transcript(spark, sf):
    from ..operators.transcript import transcript_lines
    return transcript_lines(tables.conversations(spark, sf))


# ------------------------------------------------------------------ store
@query
def list_collections(spark, sf):
    from ..operators import store
    return store.list_collections(D.written_store(spark, sf).read())


@query
def collection_counts(spark, sf):
    from ..operators import store
    return store.collection_counts(D.written_store(spark, sf).read())


@query
def collection_inventory(spark, sf):
    from ..operators import store
    return store.inventory(D.written_store(spark, sf).read())


@query
def scoped_chunks(spark, sf):
    s = retrieval.scope_filter(D.store_chunks(spark, sf, include_web=False), "en", folder="src3")
    return s.select("collection", "chunk_id", "text")


@query
def collection_selector(spark, sf):
    c = D.written_store(spark, sf).read()
    parts = [retrieval.select_collections(c, sel).select(F.lit(sel).alias("selector"), "collection",
                                                         "chunk_id")
             for sel in ("ALL", "user_fr_docs")]
    return parts[0].unionByName(parts[1])


def _ingest_batches(spark, sf):
    """Every document chunk in two batches that share the French ones; any other or null language is in the second."""
    c = D.store_chunks(spark, sf, include_web=False)
    first = c.where(F.col("collection").isin("user_en_docs", "user_fr_docs"))
    second = (c.where(~F.col("collection").eqNullSafe("user_en_docs"))
              .withColumn("source_type", F.lit("reingest")))
    return first, second


def _store_batches(spark, sf):
    """The whole chunk table, web chunks included, in two batches that overlap by the first digit of the id's md5."""
    c = D.store_chunks(spark, sf)
    digit = F.substring(F.md5(F.col("chunk_id").cast("binary")), 1, 1)
    return c.where(digit <= "a"), c.where(digit >= "5").withColumn("source_type", F.lit("reingest"))


@query
def add_if_absent(spark, sf):
    from ..operators import store
    first, second = _ingest_batches(spark, sf)
    return store.add_if_absent(first, second).select("collection", "chunk_id", "source_type")


@query
def add_if_absent_store(spark, sf):
    from ..operators import store
    first, second = _store_batches(spark, sf)
    return store.add_if_absent(first, second).select("collection", "chunk_id", "source_type")


def _store_rows(spark, sf):
    """The whole chunk table; web chunks come without a collection, as a delivery that names none."""
    c = D.store_chunks(spark, sf)
    return c.withColumn("collection", F.when(F.col("source_type") != "web", F.col("collection")))


@query
def store_replay(spark, sf):
    """K1, T3 through ``ChunkStore``: two overlapping deliveries, the second sent twice."""
    from ..operators.partitioning import written
    from ..operators.store import ChunkStore
    from ..session import scratch_path
    rows = written(_store_rows(spark, sf), "store-rows")
    digit = F.substring(F.md5(F.col("chunk_id").cast("binary")), 1, 1)
    again = rows.where(digit >= "5").withColumn("source_type", F.lit("reingest"))
    st = ChunkStore(spark, scratch_path(spark, "store-replay"))
    for delivery in (rows.where(digit <= "a"), again, again):
        st.add(delivery)
    return st.read().select("collection", "chunk_id", "source_type")


@query
def store_delete(spark, sf):
    """K9 through ``ChunkStore``: every chunk of a document labelled toxic, and listed chunks without a collection."""
    from ..operators.partitioning import written
    from ..operators.store import ChunkStore
    from ..session import scratch_path
    rows = written(_store_rows(spark, sf), "store-rows")
    st = ChunkStore(spark, scratch_path(spark, "store-delete"))
    st.add(rows)
    toxic = tables.table(spark, sf, "labels").where(F.col("toxic") == 1).select(
        F.col("doc_id").cast("string").alias("doc_key"))
    listed = F.col("collection").isNull() & (F.substring(F.md5(F.col("chunk_id").cast("binary")), 1, 1) <= "3")
    st.delete_ids(rows.join(toxic, "doc_key", "left_semi").select("collection", "chunk_id").unionByName(
        rows.where(listed).select("collection", "chunk_id")))
    return st.read().select("collection", "chunk_id")


@query
def ingest_ledger(spark, sf):
    """Documents delivered under file names that two ids share, in three batches: odd ids, then all, then
    even ids again with the right to replace."""
    from ..operators.ledger import IngestLedger, ingest_documents
    from ..operators.partitioning import materialize
    from ..operators.store import ChunkStore
    from ..session import scratch_path
    docs = tables.documents(spark, sf).select(
        "doc_id", collection_name(F.col("lang")).alias("collection"),
        F.concat(F.lit("doc_"), F.floor(F.col("doc_id") / 2).cast("string")).alias("doc_key"), "source", "text")
    store = ChunkStore(spark, scratch_path(spark, "ledger-store"))
    ledger = IngestLedger(spark, scratch_path(spark, "ledger"))
    receipts = []
    for n, (rows, replace) in enumerate(((docs.where("doc_id % 2 = 1"), False), (docs, False),
                                         (docs.where("doc_id % 2 = 0"), True)), 1):
        # deliveries of a batch are numbered by their document
        batch = rows.withColumn("delivery", F.lpad(F.col("doc_id").cast("string"), 20, "0"))
        got = ingest_documents(batch, store, ledger, _fixture_chunks, replace)
        receipts.append(materialize(got.select("doc_id", F.lit(n).cast("bigint").alias("delivery"), "status", "chunks")))
    return receipts[0].unionByName(receipts[1]).unionByName(receipts[2])


def _fixture_chunks(docs):
    return chunking.explode_chunks(docs, "doc_key", "text", chunking.CHUNK_SIZE, D.FIXTURE_SEP, keep=["collection", "source"])


@query
def delete_by_ids(spark, sf):
    """Moderation clean-up: delete every chunk of a document labelled toxic."""
    from ..operators import store
    c = D.written_store(spark, sf).read()
    toxic = tables.table(spark, sf, "labels").where(F.col("toxic") == 1).select(
        F.col("doc_id").cast("string").alias("doc_key"))
    ids = c.join(toxic, "doc_key", "left_semi").select("collection", "chunk_id")
    return store.delete_by_ids(c, ids).select("collection", "chunk_id")


@query
def clear_collection(spark, sf):
    from ..operators import store
    req = D.users(spark, sf).users.select("collection").unionByName(
        D.page_requests(spark, sf).select(F.concat(F.lit("user_"), "username", F.lit("_docs"))
                                          .alias("collection")))
    return store.clear_collections(D.written_store(spark, sf).read(), req)


@query
def chunk_metadata(spark, sf):
    """The stored metadata map of every crawled chunk."""
    c = D.written_store(spark, sf).read().where("source_type = 'web'")
    return c.select("chunk_id", "domain", "title", F.explode("metadata").alias("name", "value"))


@query
def sitemap_chunks(spark, sf):
    """C1 with its default blank-line separator on real text: pages joined with their derived links."""
    from ..operators import web
    parsed, links = _sitemap(spark, sf)
    pages = web.pages_with_links(parsed, materialized=True, links=links)
    return chunking.explode_chunks(pages, "page_id", "text").select("page_id", "chunk_index", "text")


# ------------------------------------------------------------------ users
@query
def user_lookup(spark, sf):
    from ..operators import registry
    return registry.lookup(D.users(spark, sf), D.page_requests(spark, sf))


@query
def user_folders(spark, sf):
    from ..operators import registry
    return registry.user_folders(D.users(spark, sf), D.page_requests(spark, sf)).drop("pos")


@query
def add_folders(spark, sf):
    from ..operators import registry
    reqs = D.page_requests(spark, sf).unionByName(
        tables.documents(spark, sf).select(F.col("lang").alias("username"), F.col("source").alias("folder")))
    return registry.add_folders(D.users(spark, sf), reqs)


@query
def clear_folders(spark, sf):
    from ..operators import registry
    return registry.clear_folders(D.users(spark, sf), D.page_requests(spark, sf))


@query
def clear_all_user_data(spark, sf):
    """A user's chunks (K8) and folders (K10) are cleared; True only when
    both succeed.  Requests: every user named by a crawled page URL."""
    from ..operators import registry, store
    users = D.users(spark, sf)
    req = D.page_requests(spark, sf).select("username").distinct()
    k8 = store.clear_collections(
        D.written_store(spark, sf).read(),
        req.select(F.concat(F.lit("user_"), "username", F.lit("_docs")).alias("collection")))
    return registry.clear_all(users, k8, req)


# ------------------------------------------------------------------ chat
@query
def scoped_context(spark, sf):
    return retrieval.scoped_context(D.store_chunks(spark, sf, include_web=False), D.chat_questions(spark, sf))


@query
def chat_prompt(spark, sf):
    from ..operators.prompts import chat_parts
    return chat_parts(retrieval.request_scopes(D.chat_questions(spark, sf)), scoped_context(spark, sf))
