"""End-to-end jobs for the reference's workflows, composed from the operators.

Each takes and returns DataFrames (or writes through ``ChunkStore``); all
work runs on Spark.

* ``ingest_path``   - files -> chunks (+ embeddings) in a user's collection
* ``ingest_pages``  - crawled pages (+ linked pages) -> chunks + receipts
* ``chat``          - chat requests -> scoped prompts, or the no-documents answer
* ``ask``           - questions -> ranked (hashed-vector) context -> CLI prompts
* ``curate_training`` - JSON/CSV examples -> cleaned distinct texts and pairs
* ``clear_user``    - a user's chunks and folders
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import empty_placeholder
from .operators import prompts, registry, retrieval, store, trainset, web
from .operators.chunking import CHUNK_SIZE, PARAGRAPH_SEP, explode_chunks
from .operators.embedding import HASH_DIM, embed
from .operators.lexical import lexical_hits
from .operators.ledger import IngestLedger
from .operators.memo import InferenceMemo
from .operators.partitioning import materialize
from .sources.corpus import read_corpus_files
from .sources.files import read_files


def ingest_path(spark: SparkSession, path: str, chunk_store: store.ChunkStore, username: str | None = None,
                collection: str = "default", metadata: dict | None = None, provider=None,
                dim: int = 768, input_cap: int | None = None, ledger: IngestLedger | None = None,
                delivery: str = "", every_file: bool = False) -> DataFrame:
    """Path A for every file under ``path``; returns per-file receipts.  ``input_cap``: characters that the
    provider takes at once.  ``ledger`` and ``delivery``: see ``ingest_files``.  ``every_file``: through the
    corpus source, which lists zero-length files too."""
    from .streaming.ingest import ingest_files

    coll = f"user_{username}_docs" if username else collection
    files = read_corpus_files(spark, path) if every_file else read_files(spark, path)
    return ingest_files(files, chunk_store, coll, metadata, provider, dim, input_cap, ledger, delivery)


def ingest_pages(pages: DataFrame, chunk_store: store.ChunkStore, collection: str = "default",
                 metadata: dict | None = None, follow_links: bool = True,
                 max_links: int | None = None) -> DataFrame:
    """Path B over a crawl table (page_id, url, html[, content_type]): page
    text with linked pages, placeholder, packing, md5 ids, merged metadata;
    returns one receipt per page.

    A page that failed to parse stores nothing and links to nothing.  Of several crawls of one URL the
    one with the lowest page_id that parsed is stored, whole."""
    parsed = materialize(web.parsed_pages(pages))
    html_pages = web.first_crawl(parsed.where((web.content_kind(F.col("content_type")) == "html")
                                              & F.col("parse_error").isNull()))
    content = web.pages_with_links(html_pages, max_links, follow_links, materialized=True)
    meta = web.page_metadata(parsed, metadata).select("page_id", "document_name", "metadata")
    content = (content.join(meta, "page_id")
               .withColumn("text", empty_placeholder(F.col("text"), F.col("url"), kind="url"))
               .withColumn("doc_key", F.md5("url")))
    chunks = explode_chunks(content, "doc_key", "text", CHUNK_SIZE, PARAGRAPH_SEP,
                            keep=["url", "domain", "title", "document_name", "metadata"])
    rows = chunks.select(
        F.lit(collection).alias("collection"), "chunk_id", "doc_key", "chunk_index", "text",
        "document_name", F.element_at("metadata", F.lit("folder_name")).alias("folder_name"),
        F.col("url").alias("source"), F.lit("web").alias("source_type"),
        F.element_at("metadata", F.lit("content_type")).alias("content_type"), "domain", "title", "metadata")
    chunk_store.add(rows)
    return web.url_batch(pages.select("url"), parsed, collection, max_links, follow_links,
                         materialized=True)


def chat(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Path C for a batch of requests (query_id, username, query, folder_name, document_name): ordered prompt
    rows (``prompts.chat_parts``), every chunk of the scope, or the no-documents answer."""
    return prompts.chat_parts(retrieval.request_scopes(requests), retrieval.scoped_context(chunks, requests))


def answer(chunks: DataFrame, requests: DataFrame, model, budget: int, memo: InferenceMemo | None = None,
           model_name: str = "model") -> DataFrame:
    """Path C from request to answer (query_id, prompt, response): prompts of at most ``budget`` characters of
    context through the caller's batch function ``model``; scopes without documents keep their message.
    With ``memo`` a prompt that an earlier job has answered with ``model_name`` is looked up."""
    asked = prompts.assemble_prompts(chat(chunks, requests), budget)
    return _answered(asked, model, memo, model_name)


def _answered(asked: DataFrame, model, memo: InferenceMemo | None = None, model_name: str = "model") -> DataFrame:
    ready = asked.where("prompt IS NOT NULL").drop("response")
    got = prompts.infer(ready, model) if memo is None else memo.infer(ready, model, model_name)
    return got.select("query_id", "prompt", "response").unionByName(
        asked.where("prompt IS NULL").select("query_id", "prompt", "response"))


def ask(chunks: DataFrame, questions: DataFrame, budget: int, selector: str | None = None, model=None,
        provider=None, k: int | None = None, dim: int = HASH_DIM) -> DataFrame:
    """Path D for a batch of questions (query_id, query): the CLI prompt over ranked chunks of the selected
    collection(s) within ``budget`` characters; questions without any hit get the no-documents answer.

    Without ``provider`` chunks rank by their term vectors.  With ``provider`` (the batch embedding function
    the chunks were stored with) the questions are embedded and ranked against the stored ``embedding``
    column, the ``k`` nearest chunks of each.  ``model`` turns prompts into responses."""
    scoped = retrieval.select_collections(chunks, selector)
    if provider is None:
        ranked = materialize(lexical_hits(scoped, questions, budget=budget))
        kept = retrieval.ranked_rows(ranked, scoped, budget)
    else:
        if k is None:
            raise ValueError("ranking by stored vectors needs k")
        vectors = embed(questions.select("query_id", "query"), provider, "query", dim=dim)
        stored = scoped.where("embedding IS NOT NULL")
        top = retrieval.topk(stored, vectors, k, id_col="chunk_id")
        texts = stored.select("chunk_id", "collection", "text")
        ranked = materialize(top.select("query_id", "rank", "chunk_id", "collection").join(
            texts.withColumn("n_chars", F.length("text")).drop("text"), ["chunk_id", "collection"]))
        kept = retrieval.context_budget(ranked, [F.col("rank")], budget, size=F.col("n_chars"))
        kept = kept.join(texts, ["chunk_id", "collection"])
    context = retrieval.with_empty_contexts(ranked, retrieval.ordered_concat(kept, ["query_id"], "rank"))
    out = prompts.ranked_prompts(questions, context)
    return out if model is None else _answered(out, model)


def top_chunks(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """R5 over term vectors: the k best chunks per question."""
    return retrieval.rank_sparse(chunks, questions, k)


def curate_training(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame,
                                                                                 DataFrame]:
    """S10 + X17 + A3 + X18: (distinct cleaned texts, question/answer pairs,
    rows without the pair mark)."""
    distinct = trainset.clean_distinct(trainset.read_examples(spark, path, fmt))
    pairs, rejects = trainset.split_pairs(distinct)
    return distinct, pairs, rejects


def clear_user(chunk_store: store.ChunkStore, users: registry.Registry,
               usernames: list[str]) -> tuple[DataFrame, registry.Registry]:
    """Chunks (K8) and folders (K10) of the users; True only if both succeed.  Returns (result rows, the
    registry after the clear); the store gets a new version without those collections."""
    spark = chunk_store.spark
    req = spark.createDataFrame([(u,) for u in usernames], "username string")
    k8 = chunk_store.clear([f"user_{u}_docs" for u in usernames])
    return registry.clear_all(users, k8, req), registry.apply_folder_clears(users, req)
