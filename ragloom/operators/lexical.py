"""Questions against chunks by their term vectors, scored block against block.

A posting join forms one row per (question, chunk, shared token), nearly all of them for words that
stand everywhere.  Here the vectors stay whole: chunk vectors are packed into blocks of about
``BLOCK_CHARS`` of text, question vectors into blocks of ``QUESTION_ROWS``, every question block meets
every chunk block in an equi-join on the block number, and a task scores a pair of blocks with numpy
(the token lists are matched by binary search, products are summed per question and chunk).

A task keeps, per question, only what the cut can ask for: the ``k`` best, or the best chunks
whose texts fit the budget and the one behind them.  Both are prefixes of the ranking, and a prefix of the
whole ranking holds, of any part of it, a prefix; so cutting every part first loses nothing.  Scores are exact; chunks that
share no token with a question score 0 and are not ranked.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .embedding import term_weights
from .partitioning import materialize

BLOCK_CHARS = 1 << 21       # text of one chunk block (expected; packing is by hash)
CHUNK_CHARS = 64            # a chunk counts as so many characters more than it has
QUESTION_ROWS = 128         # questions of one question block (expected)
CELLS = 2_000_000           # products formed at once in a task
HELD_ROWS = 500_000         # hits a task holds before it sends what it has
PLACES = 9                  # decimals that scores are ranked by


def term_vectors(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, n_chars, tokens (64-bit hashes, ascending) and unit-length weights of every text that has a token."""
    v = df.select(key, F.length(text_col).cast("long").alias("n_chars"), term_weights(F.col(text_col)).alias("v"))
    return v.select(key, "n_chars", "v.tokens", "v.weights").where(F.size("tokens") > 0)


class _Vectors:
    """A block of vectors out of an Arrow list of structs (key, n_chars, tokens, weights)."""

    def __init__(self, structs: pa.StructArray):
        key, chars, tokens, weights = structs.flatten()
        self.key = np.asarray(key.to_pylist(), object)
        self.chars = chars.to_numpy(zero_copy_only=False)
        self.token = tokens.flatten().to_numpy()
        self.weight = weights.flatten().to_numpy()
        self.row = np.repeat(np.arange(len(self.key)), tokens.value_lengths().to_numpy())


def block_scores(questions: _Vectors, chunks: _Vectors) -> np.ndarray:
    """(chunks, questions) dot products."""
    order = np.argsort(questions.token, kind="stable")
    token, weight, row = questions.token[order], questions.weight[order], questions.row[order]
    known, start, count = np.unique(token, return_index=True, return_counts=True)
    out = np.zeros(len(chunks.key) * len(questions.key))
    if not len(known):
        return out.reshape(len(chunks.key), -1)
    at = np.minimum(np.searchsorted(known, chunks.token), len(known) - 1)
    hit = known[at] == chunks.token
    at, c_weight, c_row = at[hit], chunks.weight[hit], chunks.row[hit]
    n = count[at]
    end = np.cumsum(n)
    a = 0
    while a < len(n):                   # products of one posting are at most the questions of a block
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + CELLS, "right")))
        each = np.repeat(np.arange(a, b), n[a:b])
        place = start[at[each]] + np.arange(len(each)) - np.repeat(end[a:b] - n[a:b] - (end[a - 1] if a else 0), n[a:b])
        out += np.bincount(c_row[each] * len(questions.key) + row[place], c_weight[each] * weight[place], len(out))
        a = b
    return out.reshape(len(chunks.key), -1)


def _leading(score: np.ndarray, chars: np.ndarray, key: np.ndarray, k: int | None, budget: int | None, sep: int):
    """Indexes of the rows that can be in the cut, best first.  With a budget also the first row past it: it keeps
    out what other parts have behind it."""
    order = np.lexsort((key, -score))
    if k is not None:
        return order[:k]
    used = np.cumsum(chars[order] + sep) - sep
    return order[:int(np.searchsorted(used, budget, "right")) + 1]


def _hits(k, budget, sep, schema, batches):
    held: dict = {}
    size = 0

    def flush():
        rows = [(q, *hit) for q, (score, chars, keys) in held.items()
                for hit in zip(keys.tolist(), score.tolist(), chars.tolist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                             schema=schema)

    for batch in batches:
        for r in range(batch.num_rows):
            questions, chunks = (_Vectors(batch.column(i).slice(r, 1).flatten()) for i in (0, 1))
            scores = np.round(block_scores(questions, chunks), PLACES)
            name = np.unique(chunks.key, return_inverse=True)[1]        # order numbers of the keys
            for j, q in enumerate(questions.key.tolist()):
                found = np.flatnonzero(scores[:, j] > 0)
                if not len(found):
                    continue
                best = found[_leading(scores[found, j], chunks.chars[found], name[found], k, budget, sep)]
                new = (scores[best, j], chunks.chars[best], chunks.key[best])
                if q in held:
                    size -= len(held[q][0])
                    new = tuple(np.concatenate(x) for x in zip(held[q], new, strict=True))
                    keep = _leading(new[0], new[1], np.unique(new[2], return_inverse=True)[1], k, budget, sep)
                    new = tuple(x[keep] for x in new)
                held[q] = new
                size += len(new[0])
            if size > HELD_ROWS:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def lexical_hits(chunks: DataFrame, questions: DataFrame, k: int | None = None, budget: int | None = None,
                 sep_len: int = 2, chunk_key: str = "chunk_id", query_key: str = "query_id",
                 text_col: str = "text", query_col: str = "query") -> DataFrame:
    """(query_id, chunk_id, score, n_chars): a part of every question's ranking that holds all that a cut at
    ``k`` chunks, or at ``budget`` characters (texts and separators), asks for, the best chunk in any case.

    Scores are rounded to ``PLACES`` decimals, by which they rank.  Null and empty texts have no token and are
    in no result.  Two numbers reach the driver.  The join is no broadcast: question blocks are copied for every
    chunk block, so that side grows with both."""
    if (k is None) == (budget is None):
        raise ValueError("cut at k chunks or at a budget of characters")
    c = term_vectors(chunks, chunk_key, text_col)
    q = materialize(term_vectors(questions, query_key, query_col))
    chars = chunks.agg(F.sum(F.length(text_col).cast("long") + CHUNK_CHARS)).first()[0] or 0
    n_blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    n_parts = max(1, -(-q.count() // QUESTION_ROWS))

    def packed(df, key, group):
        return df.groupBy(group).agg(F.collect_list(F.struct(F.col(key).alias("key"), "n_chars", "tokens", "weights")).alias("v"))

    blocks = packed(c, chunk_key, F.pmod(F.xxhash64(chunk_key, "n_chars", "tokens"), F.lit(n_blocks)).cast("int").alias("block"))
    parts = packed(q, query_key, F.pmod(F.xxhash64(query_key), F.lit(n_parts)).alias("part")).select(
        F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    met = parts.hint("merge").join(blocks, "block").select("q", "v")
    out = T.StructType([T.StructField(query_key, questions.schema[query_key].dataType),
                        T.StructField(chunk_key, chunks.schema[chunk_key].dataType),
                        T.StructField("score", T.DoubleType()), T.StructField("n_chars", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    return met.mapInArrow(partial(_hits, k, budget, sep_len, to_arrow_schema(out)), out)
