"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (character classes, word and line repetition, lengths)
are binned by quantiles of the fitting sample; trees grow level by level on
gradient histograms and are stored flat (feature, bin threshold, leaf value per
heap position), so a block of documents walks all trees with one numpy gather per
level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, hash_share, map_text

FIT_ROWS = 20_000       # labelled rows the trees are fitted on (expected; at most twice that)
BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 64, 80, 4, 0.15, 2.0, 12
THRESHOLD = 0.7

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "lower", "digit", "non_ascii", "space",
            "stop_mark", "comma", "exclaim", "pipe", "symbol", "brace", "breaks", "unique_words",
            "same_as_previous", "top_word", "longest_word", "short_words", "unique_lines", "line_length",
            "capital_words", "marked_words")

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "non_ascii": range(128, 256),
            "space": b" \t\n\r", "stop_mark": b".", "comma": b",;:", "exclaim": b"!?", "pipe": b"|",
            "symbol": b"#*$%&<>@^~+", "brace": b"{}[]()=_/\\\"'", "breaks": b"\n"}
_MASK = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _MASK[list(_members), _i] = 1.0


def document_statistics(texts: list) -> np.ndarray:
    """One row of FEATURES per text; null and empty texts: all zero."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "replace")
        n = len(raw)
        share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MASK / n
        words = raw.split()
        w = len(words)
        row = out[i]
        row[0], row[1] = np.log1p(n), np.log1p(w)
        row[3:15] = share
        if w:
            length = np.fromiter(map(len, words), np.int64, w)
            code = np.fromiter(map(hash, words), np.int64, w)   # equality within this text only
            kinds, times = np.unique(code, return_counts=True)
            row[2] = length.mean()
            row[15] = len(kinds) / w
            row[16] = (code[1:] == code[:-1]).mean() if w > 1 else 0.0
            row[17] = times.max() / w
            row[18] = np.log1p(length.max())
            row[19] = (length <= 3).mean()
            row[22] = sum(map(bytes.isupper, words)) / w
            row[23] = 1.0 - sum(map(bytes.isalpha, words)) / w
        lines = raw.split(b"\n")
        row[20] = len(set(lines)) / len(lines)
        row[21] = np.log1p(n / len(lines))
    return out


class BoostedTrees:
    """Flat trees: heap position p has children 2p+1 and 2p+2."""

    def __init__(self, edges, base, feature, cut, value):
        self.edges, self.base, self.feature, self.cut, self.value = edges, base, feature, cut, value

    @staticmethod
    def _bin(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1) \
            if len(x) else np.zeros((0, len(edges)), np.int64)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> BoostedTrees:
        n_f = x.shape[1]
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        edges = [np.unique(np.quantile(x[:, j], grid)) if len(x) else np.zeros(0) for j in range(n_f)]
        inner, leaves = 2 ** depth - 1, 2 ** depth
        if not len(y):
            return cls(edges, 0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, leaves)))
        binned = cls._bin(x, edges)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), base)
        feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS, np.int64)
        value = np.zeros((trees, leaves))
        flat = binned + np.arange(n_f) * BINS
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = 2 ** level - 1, 2 ** level
                at = ((node - first)[:, None] * (n_f * BINS) + flat).ravel()
                size = width * n_f * BINS
                g, h, c = (np.bincount(at, weights=np.repeat(v, n_f), minlength=size)
                           .reshape(width, n_f, BINS).cumsum(2) for v in (grad, hess, np.ones(len(y))))
                gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
                gain = g ** 2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt ** 2 / (ht + RIDGE)
                gain[(c < LEAST) | (ct - c < LEAST)] = 0.0
                best = gain.reshape(width, -1).argmax(1)
                good = gain.reshape(width, -1).max(1) > 1e-9
                here = slice(first, first + width)
                feature[t, here] = best // BINS
                cut[t, here] = np.where(good, best % BINS, BINS)    # all to the left where nothing is gained
                right = binned[np.arange(len(y)), feature[t, node]] > cut[t, node]
                node = 2 * node + 1 + right
            leaf = node - inner
            g, h = (np.bincount(leaf, weights=v, minlength=leaves) for v in (grad, hess))
            value[t] = -RATE * g / (h + RIDGE)
            raw += value[t][leaf]
        return cls(edges, base, feature, cut, value)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of statistics."""
        if not len(x):
            return np.zeros(0)
        binned = self._bin(x, self.edges)
        n, trees = len(x), len(self.value)
        node = np.zeros((n, trees), np.int64)
        rows, every = np.arange(n)[:, None], np.arange(trees)[None, :]
        inner = self.feature.shape[1]
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (binned[rows, self.feature[every, node]] > self.cut[every, node])
        raw = self.base + self.value[every, node - inner].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> BoostedTrees:
    """Trees fitted on about ``fit_rows`` labelled documents, chosen by hash of the id from the rows
    whose fold (crc32 of the id, modulo 4) is not 2.  Labels without a document, null labels and
    null ids are left out."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("quality")) \
        .filter(F.col("quality").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    n = known.count()
    if not n:
        return BoostedTrees.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    sample = known.filter(hash_share(F.col("doc_id"), fit_rows / n))
    pool = docs.select("doc_id", "text").filter(hash_share(F.col("doc_id"), fit_rows / n))
    rows = (statistics_of(pool, ["doc_id"]).join(sample, "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "statistics").limit(2 * fit_rows)
            .select("quality", "statistics").toPandas())
    if not len(rows):
        return BoostedTrees.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return BoostedTrees.fit(np.stack(rows["statistics"].to_numpy()), rows["quality"].to_numpy())


def statistics_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    def make():
        return lambda texts: {"statistics": pa.array(list(document_statistics(texts)), pa.list_(pa.float64()))}

    return map_text(docs, keep, "text", "statistics array<double>", make)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every row.

    Null and empty texts are scored from all-zero statistics; repeated rows are scored one by one;
    other columns are ignored; an empty table gives an empty result; without labels every score is
    0.5.  Texts are measured whole."""
    model = fit_quality(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TREES * 2 ** DEPTH numbers

    def make():
        trees = shared.value
        return lambda texts: {"score": pa.array(trees.score(document_statistics(texts)), pa.float64())}

    out = map_text(docs, ["doc_id"], "text", "score double", make)
    held = F.coalesce(fold(F.col("doc_id"), 4), F.lit(0)) == 2
    return out.select("doc_id", held.alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
