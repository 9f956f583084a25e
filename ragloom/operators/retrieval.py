"""F1-F4 filters, J3-J6 question-to-chunk retrieval, R1-R6 ranking.

Dense top-k (J3, R5) meets a question set with all stored vectors in blocks: bounds
from one-byte approximations choose the pairs (see ``vafile``), and only these pairs
meet the vectors themselves.  Lexical retrieval (J4) meets question and
chunk vectors in the same way, see ``lexical``.  Nothing is fetched to the driver but counts.

Contexts (J6, A1) are ordered rows over each distinct scope, never one value, and
nothing is cut from them.  A budget (R6) is what a caller asks for explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collection_name
from ..functions.vectors import l2_normalize
from .lexical import lexical_hits
from .ranking import distributed_row_number, topk_per_group, weighted_prefix
from .vafile import candidates

# Places that distances and scores are rounded to before they rank.
PLACES = 9


# ---------------------------------------------------------------- filters
def scope_filter(chunks: DataFrame, username=None, folder=None, document=None) -> DataFrame:
    """chunks of the user's collection, equality on folder and/or document
    name when given; Catalyst prunes the ``collection`` partition."""
    out = chunks
    if username is not None:
        out = out.where(F.col("collection") == collection_name(F.lit(username)))
    if folder:
        out = out.where(F.col("folder_name") == F.lit(folder))
    if document:
        out = out.where(F.col("document_name") == F.lit(document))
    return out


def select_collections(chunks: DataFrame, selector: str | None) -> DataFrame:
    """a named collection, or every collection for None / 'all' (any case)."""
    if selector is None or selector.lower() == "all":
        return chunks
    return chunks.where(F.col("collection") == F.lit(selector))


# ---------------------------------------------------------------- dense scoring
def _metric_vector(vec, metric: str):
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    v = F.transform(vec, lambda x: x.cast("double"))
    return l2_normalize(v) if metric == "cosine" else v


def score_pairs(stored: DataFrame, questions: DataFrame, pairs: DataFrame, id_col: str = "vec_id",
                coll_col: str = "collection", vec_col: str = "embedding", qid: str = "query_id",
                qvec: str = "embedding", metric: str = "l2") -> DataFrame:
    """R1/R2 over a given pair table (``qid``, ``id_col``): squared L2 distance (or 1 - cosine) and
    similarity = max(0, 1 - distance).  Two equi-joins; one row per given pair."""
    q = questions.select(qid, _metric_vector(F.col(qvec), metric).alias("_q"))
    s = stored.select(id_col, F.col(coll_col).alias("collection"), _metric_vector(F.col(vec_col), metric).alias("_v"))
    scale = 0.5 if metric == "cosine" else 1.0
    squares = F.zip_with("_v", "_q", lambda a, b: (a - b) * (a - b))
    d = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) * scale
    out = pairs.select(qid, id_col).join(q, qid).join(s, id_col)
    return (out.withColumn("distance", d)
            .withColumn("similarity", F.greatest(F.lit(0.0), 1.0 - F.col("distance")))
            .select(qid, id_col, "collection", "distance", "similarity"))


# R4 order: similarity desc, then collection, distance and id (stable tie rule).
def hit_order(id_col: str = "vec_id"):
    return [F.round("similarity", PLACES).desc(), F.col("collection").asc(), F.round("distance", PLACES).asc(),
            F.col(id_col).asc()]


def rank_all(scored: DataFrame, qid: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """Every scored pair numbered within its question (nothing cut)."""
    return distributed_row_number(scored, [qid], hit_order(id_col))


def topk(stored: DataFrame, questions: DataFrame, k: int, id_col: str = "vec_id", coll_col: str = "collection",
         vec_col: str = "embedding", qid: str = "query_id", qvec: str = "embedding", metric: str = "l2") -> DataFrame:
    """Exact top-k per question; ids of any type.  Bounds from one-byte approximations choose the pairs
    (``vafile``), whose distances are exact differences, ranked by PLACES decimals; vectors without a value or
    of another width than the question take no part."""
    scale = 0.5 if metric == "cosine" else 1.0
    s = stored.select(F.col(id_col).alias("i"), F.col(coll_col).cast("string").alias("c"),
                      _metric_vector(F.col(vec_col), metric).alias("v")).where("v IS NOT NULL")
    q = questions.select(F.col(qid).alias("qi"), _metric_vector(F.col(qvec), metric).alias("qv")).where("qv IS NOT NULL")
    pairs = candidates(s, q, k, scale).alias("p")
    same = F.col("p.i").eqNullSafe(F.col("s.i")) & F.col("p.c").eqNullSafe(F.col("s.c"))
    met = pairs.join(s.alias("s"), same).join(q.alias("q"), F.col("p.qi") == F.col("q.qi")).where(
        F.size("s.v") == F.size("q.qv"))
    squares = F.zip_with("s.v", "q.qv", lambda a, b: (a - b) * (a - b))
    found = met.select(F.col("p.qi").alias(qid), F.col("p.i").alias(id_col), F.col("p.c").alias("collection"),
                       (F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) * scale).alias("distance"))
    found = found.withColumn("similarity", F.greatest(F.lit(0.0), 1.0 - F.col("distance")))
    return topk_per_group(found, [qid], hit_order(id_col), k)


# ---------------------------------------------------------------- lexical
def lexical_order(chunk_key: str = "chunk_id"):
    return [F.col("score").desc(), F.col(chunk_key).asc()]


def rank_sparse(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """J4 + R5: (query_id, rank, chunk_id, score) of the k best chunks per question."""
    return topk_per_group(lexical_hits(chunks, questions, k=k).drop("n_chars"), ["query_id"], lexical_order(), k)


def context_budget(ranked: DataFrame, order: list, budget: int, sep_len: int = 2, group: str = "query_id",
                   size=None, rank: str = "_r") -> DataFrame:
    """Rows in rank order while the running length (texts plus separators) stays within ``budget``, with
    ``rank`` and ``used_chars``.  ``size``: the length of a row's text (of column ``text``, if not given).

    The cut is a weighted prefix sum over all rows (``weighted_prefix``), so the layout of the data does not
    matter; give rows without their texts and join these to what is kept."""
    size = F.length("text") if size is None else size
    kept = weighted_prefix(ranked, [group], order, size + F.lit(sep_len), budget + sep_len, rank, "used_chars")
    return kept.withColumn("used_chars", F.col("used_chars") - F.lit(sep_len))


def budget_rows(hits: DataFrame, budget: int) -> DataFrame:
    """Hits (``lexical_hits``) within a caller's budget: query_id, rank, chunk_id, used_chars."""
    kept = context_budget(hits, lexical_order(), budget, size=F.col("n_chars"), rank="rank")
    return kept.select("query_id", "rank", "chunk_id", "used_chars")


def ranked_rows(hits: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """Ranked context within a caller's budget as ordered rows: query_id, rank, chunk_id, text, used_chars."""
    return budget_rows(hits, budget).join(chunks.select("chunk_id", "text"), "chunk_id")


def with_empty_contexts(hits: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, context) of every question in ``hits`` (rows with query_id): one whose first chunk exceeds
    the budget has hits and an empty context."""
    return (hits.select("query_id").distinct().join(contexts, "query_id", "left")
            .withColumn("context", F.coalesce("context", F.lit(""))))


def ordered_concat(df: DataFrame, group: list[str], order_col: str, text_col: str = "text",
                   sep: str = "\n\n", out: str = "context") -> DataFrame:
    """A1: texts joined with ``sep`` in ``order_col`` order, for rows that ``context_budget`` has bounded."""
    return (df.groupBy(*group)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                      F.col(text_col).alias("t")))).alias("_l"))
            .select(*group, F.array_join(F.transform("_l", lambda s: s["t"]), sep).alias(out)))


# ---------------------------------------------------------------- scopes
def _scope(shape, collection, folder, document):
    """One key of a scope: the parts as a JSON array, so that no character in a name runs into the next part
    (no collection: no key)."""
    return F.when(collection.isNotNull(), F.to_json(F.array(shape, collection, folder, document)))


def request_scopes(requests: DataFrame) -> DataFrame:
    """``requests`` (username, folder_name, document_name) with ``scope``: the one key their filters name."""
    none = F.lit("")
    has_f = F.coalesce(F.col("folder_name"), none) != ""
    has_d = F.coalesce(F.col("document_name"), none) != ""
    shape = F.when(has_f & has_d, F.lit("B")).when(has_f, F.lit("F")).when(has_d, F.lit("D")).otherwise(F.lit("U"))
    return requests.withColumn("scope", _scope(
        shape, collection_name(F.col("username")), F.when(has_f, F.col("folder_name")).otherwise(none),
        F.when(has_d, F.col("document_name")).otherwise(none)))


def scoped_context(chunks: DataFrame, requests: DataFrame,
                   order_cols: tuple[str, str] = ("doc_key", "chunk_index")) -> DataFrame:
    """J6 + F1 + A1: (scope, pos, chunk_id, text), all chunks of each distinct scope in document order.

    Every chunk carries its four scope keys (user; + folder; + document; both), so matching is one
    equi-join on ids and no request is paired with chunks outside its scope; a scope that many requests
    share is built once.  Rows are numbered over range partitions, so a user who holds most chunks is no
    single task, and texts join last."""
    none = F.lit("")
    f, d = F.coalesce(F.col("folder_name"), none), F.coalesce(F.col("document_name"), none)
    keys = F.array(*(_scope(F.lit(s), F.col("collection"), x, y)
                     for s, x, y in (("U", none, none), ("F", f, none), ("D", none, d), ("B", f, d))))
    wanted = request_scopes(requests).select("scope").distinct()
    hits = (chunks.select("collection", "chunk_id", *order_cols, F.explode(keys).alias("scope"))
            .join(wanted, "scope"))
    order = [F.col(order_cols[0]), F.col(order_cols[1]), F.col("chunk_id")]
    numbered = distributed_row_number(hits, ["scope"], order, out="pos")
    return (numbered.join(chunks.select("collection", "chunk_id", "text"), ["collection", "chunk_id"])
            .select("scope", (F.col("pos") - 1).alias("pos"), "chunk_id", "text"))
