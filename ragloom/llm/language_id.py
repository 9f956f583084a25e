"""Language identification by prediction by partial matching (PPM).

Every language gets a variable-order byte context tree with frozen counts.  The
code length of a text under a language is the sum over its bytes of
``-log2 p(byte | longest known context)``: a context that has been seen codes a
known successor with n / (total + kinds) (escape method C), and otherwise pays
``kinds / (total + kinds)`` to escape to the next shorter context; below the
empty context every byte costs 8 bits.  The language with the shortest code wins
(ties: the smaller language name).

The trees of all languages share one trie, held as dense numpy arrays, so a
block of texts is scored with one gather per order.  Texts are lower-cased and
every ASCII byte that is no letter becomes a space (runs collapse), so digits,
symbols and shouting do not count as language.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, hash_share, map_text

ORDER = 4                # longest context in bytes
FIT_DOCS = 250           # documents per language the statistics are learned from (expected; at most twice that)
SAMPLE_DOCS = 20_000     # documents of all languages together
FIT_BYTES = 64 * 1024    # longest piece of a document used for fitting
MIN_COUNT = 3            # successors of the longest contexts seen less often are pruned
SCORE_BYTES = 1 << 20    # text scored at once; a worker's arrays are about 60 times that
EVIDENCE = 64            # bytes of evidence the confidence is stated for
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_EDGE = 0                # symbol before a text's first byte: no context reaches over it


def encode_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cleaned bytes of all texts (each preceded by a 0 byte) and their row numbers."""
    raw = [t.lower().encode("utf-8", "replace").translate(_TABLE) for t in texts]
    flat = np.frombuffer(b"\x00" + b"\x00".join(raw), dtype=np.uint8) if raw else np.zeros(0, np.uint8)
    lens = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    row = np.repeat(np.arange(len(raw)), lens)
    drop = np.zeros(len(flat), bool)
    drop[1:] = (flat[1:] == 32) & ((flat[:-1] == 32) | (flat[:-1] == 0))
    return flat[~drop], row[~drop]


class ContextTrees:
    """Trie over the byte strings of all languages with per-language code lengths."""

    def __init__(self, langs, symbol, child, cost, escape):
        self.langs, self.symbol, self.child, self.cost, self.escape = langs, symbol, child, cost, escape

    @classmethod
    def fit(cls, samples: dict[str, list[str]], order: int = ORDER, min_count: int = MIN_COUNT) -> ContextTrees:
        langs = sorted(samples)
        n_lang = len(langs)
        data = {x: encode_texts(samples[x])[0] for x in langs}
        present = np.zeros(256, bool)
        for d in data.values():
            present[np.unique(d)] = True
        present[0] = False
        symbol = np.zeros(256, np.int64)         # 0: edge or unseen byte
        symbol[present] = np.arange(1, present.sum() + 1)
        width = int(present.sum()) + 1
        # nodes: 0 = absent, 1 = empty string; node (string) counts per language, level by level
        counts, level_start = [np.zeros((2, n_lang))], [2]
        child_rows = {}
        code = {x: symbol[d].astype(np.int32) for x, d in data.items()}
        at = {x: np.ones(len(d), np.int32) for x, d in data.items()}
        n_nodes = 2
        for depth in range(order + 1):
            wide = np.int32 if n_nodes * width < 1 << 31 else np.int64

            def keys(x):                        # at[x]: node of the (depth) bytes before each position
                return np.where((code[x] > 0) & (at[x] > 0), at[x].astype(wide) * wide(width) + code[x], wide(0))

            # one language's positions at a time; what is kept grows with the distinct strings
            found = {}
            for x in langs:
                k = keys(x)
                found[x] = np.unique(k[k > 0], return_counts=True)
            uniq = np.unique(np.concatenate([u for u, _ in found.values()])).astype(np.int64) if found else np.zeros(0, np.int64)
            count = np.zeros((len(uniq), n_lang))
            for i, (u, times) in enumerate(found.values()):
                count[np.searchsorted(uniq, u), i] = times
            if depth == order:
                often = count.sum(1) >= min_count
                uniq, count = uniq[often], count[often]
            else:
                for x in langs:
                    k = keys(x)
                    # the node ending at i is the context of position i + 1
                    node = np.where(k > 0, np.searchsorted(uniq, k) + n_nodes, 0).astype(np.int32)
                    at[x][1:], at[x][:1] = node[:-1], 0
            counts.append(count)
            child_rows[depth] = (uniq // width, uniq % width, np.arange(n_nodes, n_nodes + len(uniq)))
            n_nodes += len(uniq)
            level_start.append(n_nodes)
        inner = level_start[-2]                 # nodes that can be a context: all but the deepest level
        child = np.zeros((inner, width), np.int32)
        for p, s, nid in child_rows.values():
            child[p, s] = nid
        count = np.concatenate(counts)
        total = np.zeros((inner, n_lang))
        kinds = np.zeros((inner, n_lang))
        for p, s, nid in child_rows.values():
            np.add.at(total, p, count[nid])
            np.add.at(kinds, p, count[nid] > 0)
        seen = total > 0
        escape = np.zeros((inner, n_lang))
        escape[seen] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
        # suffix of a node: the same string without its first byte
        suffix = np.zeros(n_nodes, np.int64)
        cost = np.zeros((n_nodes, n_lang))
        for depth in range(order + 1):      # row 0 of cost stays 0: no node, no bits
            p, s, nid = child_rows[depth]
            suffix[nid] = 1 if depth == 0 else child[suffix[p], s]
            shorter = np.full((len(nid), n_lang), 8.0) if depth == 0 else cost[suffix[nid]]
            known = count[nid] > 0
            direct = -np.log2(np.maximum(count[nid], 1) / np.maximum(total[p] + kinds[p], 1))
            cost[nid] = np.where(known, direct, escape[p] + shorter)
        return cls(langs, symbol, child, cost.astype(np.float32), escape.astype(np.float32))

    def code_lengths(self, texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
        """(bits per text and language, coded bytes per text)."""
        n, n_lang = len(texts), len(self.langs)
        data, row = encode_texts(texts)
        if not len(data) or not n_lang:
            return np.zeros((n, n_lang)), np.zeros(n)
        s = self.symbol.astype(np.int32)[data]
        width = np.int32(self.child.shape[1])
        flat = self.child.ravel()
        ctx = [np.ones(len(s), np.int32)]       # ctx[k][i]: node of the k bytes before i (0: absent)
        for k in range(order + 1):
            node = flat.take(ctx[k] * width + s)
            if k < order:
                ctx.append(np.empty_like(node))
                ctx[-1][0], ctx[-1][1:] = 0, node[:-1]
        cost = self.cost.take(node, axis=0)
        todo = np.flatnonzero(node == 0)
        todo = todo[data[todo] != _EDGE]
        for k in range(order, -1, -1):          # escape to the next shorter context
            cost[todo] += self.escape[ctx[k][todo]]
            got = flat.take(ctx[k - 1][todo] * width + s[todo]) if k else np.zeros(len(todo), np.int32)
            cost[todo] += self.cost[got]
            todo = todo[got == 0]
        cost[todo] += np.float32(8.0)
        starts = np.searchsorted(row, np.arange(n))
        bits = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return bits, np.diff(np.append(starts, len(row))) - 1.0

    def predict(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, confidence, bits per byte) of each text; None or no letter: ``und``, 0."""
        clean = [t or "" for t in texts]
        bits, size = self.code_lengths(clean)
        lettered = np.array([bool(_LETTER.search(t)) for t in clean], bool)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = bits.argmin(1) if len(texts) else np.zeros(0, int)
        per = bits / np.maximum(size, 1)[:, None]
        gap = (per - per.min(1, keepdims=True)) * np.minimum(size, EVIDENCE)[:, None]
        score = 1.0 / np.exp2(-np.minimum(gap, 500)).sum(1)
        lang = [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
        return lang, np.where(lettered, score, 0.0), np.where(lettered, per.min(1), 0.0)


def fit_language_trees(docs: DataFrame, learn, fit_docs: int = FIT_DOCS) -> ContextTrees:
    """Trees from a bounded sample: per non-null ``lang`` about ``fit_docs`` of the rows where ``learn`` holds and
    the text is not null, chosen by hash of the id (fewer of each where there are more than SAMPLE_DOCS /
    ``fit_docs`` languages).  Of a text over FIT_BYTES the sample has a piece of at most that size."""
    piece = F.when(F.octet_length("text") > FIT_BYTES, F.left("text", F.lit(FIT_BYTES // 4))).otherwise(F.col("text"))
    pool = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "lang", piece.alias("text"))
    sizes = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return ContextTrees.fit({})
    fit_docs = max(1, min(fit_docs, SAMPLE_DOCS // len(sizes)))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & hash_share(F.col("doc_id"), fit_docs / n))
    rows = (pool.filter(chosen).orderBy(F.xxhash64("doc_id"), "text")
            .limit(2 * fit_docs * len(sizes)).collect())
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r["lang"], []).append(r["text"])
    return ContextTrees.fit(samples)


def identify_language(docs: DataFrame, learn, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row plus lang_pred, score (0 to 1) and bits_per_byte.  ``text``: where the scored
    text is, as in ``map_text``.

    Null texts and texts without a letter: ``und`` with score 0.  An empty table gives an
    empty result; without any learnable row every text is ``und``.  Repeated rows are scored
    one by one; other columns are ignored.  Long texts are scored whole."""
    trees = fit_language_trees(docs, learn)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # at most 2 * FIT_DOCS pieces of a language, 2 * SAMPLE_DOCS in all

    def make():
        model = shared.value

        def fn(texts):
            lang, score, bits = model.predict(texts)
            return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()),
                    "bits_per_byte": pa.array(bits, pa.float64())}

        return fn

    return map_text(docs, keep, text, "lang_pred string, score double, bits_per_byte double", make, SCORE_BYTES)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row of ``docs``."""
    out = identify_language(docs, fold(F.col("doc_id"), 3) != 1, ["doc_id"])
    return out.select("doc_id", (F.coalesce(fold(F.col("doc_id"), 3), F.lit(0)) == 1).alias("held_out"),
                      "lang_pred", "score", "bits_per_byte")
