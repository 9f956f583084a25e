"""Token counts under a piece vocabulary by rank-synchronous merging of numpy arrays.

A text becomes pre-tokens: a run of spaces with the word behind it (the vocabulary
has no piece that continues over a following space, and none that holds a line
break).  The distinct pre-tokens of a block are held as one ragged symbol array.
In every round each pre-token's lowest-rank adjacent pair is found and all its
occurrences are merged at once, in every pre-token of the block; a pre-token leaves
the array when it has no mergeable pair.  The surviving symbols are counted: a
known piece is one token, any other character one token per UTF-8 byte.

Merging all occurrences of a pair at once equals merging them one by one because a
merge never makes a pair that ranks before it: were xy|z ranked before x|y, then
its own earlier part y|z would have been the lower pair.  Only the pieces that
consist of spaces alone share one rank, the last; a run of spaces left over is
therefore counted by a table of what leftmost-first merging makes of it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text

LIMIT = 4096                # tokens a document may have before it is flagged
MEMO_WORDS = 400_000        # counted pre-tokens a worker remembers (speed only)
MEMO_CHARS = 48             # longer pre-tokens are not remembered
SPACE = "▁"            # the vocabulary's mark for a space

_PRE = re.compile(r" *[^ \n]+| +")
_BIG = np.int64(1 << 40)


class PieceVocabulary:
    """Symbols, mergeable pairs and ranks of a sentencepiece BPE model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(sp.get_piece_size())]
        score = {sp.id_to_piece(i): sp.get_score(i) for i, s in enumerate(special) if not s}
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in score):
            raise ValueError("a piece of this vocabulary reaches over a space or a line break")
        runs = {len(p) for p in score if not p.strip(SPACE)} | {1}
        self.space_run = max(runs)
        self.space_tokens = np.array([len(self._space_pieces(n, runs)) for n in range(self.space_run)], np.int64)
        if self._space_pieces(self.space_run, runs) != [self.space_run]:
            raise ValueError("the longest space piece of this vocabulary is never reached")
        merged = [p for p in score if len(p) > 1 and p.strip(SPACE)]
        chars = sorted({c for p in score for c in p})
        symbols = {s: i for i, s in enumerate(dict.fromkeys([*chars, *score]))}
        self.known = np.array([s in score for s in symbols], bool)
        self.width = np.int64(len(symbols) + 1)
        code = np.array([ord(c) for c in chars], np.int64)
        self.char_code, self.char_symbol = code, np.array([symbols[c] for c in chars], np.int64)
        ranks = {s: r for r, s in enumerate(sorted({-score[p] for p in merged}))}
        pairs = {}
        for p in merged:
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * int(self.width) + b] = (ranks[-score[p]], symbols[p])
        key = np.array(sorted(pairs), np.int64)
        self.pair_key = np.append(key, np.iinfo(np.int64).max)
        self.pair_rank = np.append([pairs[k][0] for k in key.tolist()], _BIG).astype(np.int64)
        self.pair_symbol = np.append([pairs[k][1] for k in key.tolist()], 0).astype(np.int64)
        self.space = symbols[SPACE]

    @staticmethod
    def _space_pieces(n: int, runs: set[int]) -> list[int]:
        """Pieces that leftmost-first merging makes of a run of n spaces."""
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in runs:
                out[-2:] = [out[-2] + out[-1]]
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.searchsorted(self.pair_key, key)
        hit = (self.pair_key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], _BIG), self.pair_symbol[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token (spaces already replaced by the mark)."""
        n = len(words)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(n), np.fromiter(map(len, words), np.int64, n))
        at = np.minimum(np.searchsorted(self.char_code, code), len(self.char_code) - 1)
        # an unknown character is a symbol below 0 that merges with nothing
        sym = np.where(self.char_code[at] == code, self.char_symbol[at], -1 - code)
        total = np.zeros(n, np.int64)
        while len(sym):
            rank = np.full(len(sym), _BIG)
            into = np.zeros(len(sym), np.int64)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside], into[inside] = self.rank_of(sym[inside], sym[inside + 1])
            while True:
                start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                low = np.minimum.reduceat(rank, start)
                size = np.diff(np.append(start, len(word)))
                if (low == _BIG).any():
                    done = np.repeat(low == _BIG, size)
                    total += self._tokens(sym[done], word[done], n)
                    sym, word, rank, into = sym[~done], word[~done], rank[~done], into[~done]
                    if not len(sym):
                        break
                    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                    low, size = low[low < _BIG], size[low < _BIG]
                hit = rank == np.repeat(low, size)
                # of overlapping occurrences every second one, from the left
                index = np.flatnonzero(hit)
                first = np.append(True, np.diff(index) > 1)
                run = np.maximum.accumulate(np.where(first, np.arange(len(index)), 0))
                index = index[(np.arange(len(index)) - run) % 2 == 0]
                sym[index] = into[index]
                gone = np.zeros(len(sym), bool)
                gone[index + 1] = True
                moved = np.zeros(len(sym), bool)
                moved[index] = True
                sym, word, rank, into, moved = (x[~gone] for x in (sym, word, rank, into, moved))
                again = moved.copy()
                again[:-1] |= moved[1:]          # the pair to the left of a merged symbol
                again = np.flatnonzero(again)
                rank[again] = _BIG
                again = again[again < len(sym) - 1]
                again = again[word[again] == word[again + 1]]
                rank[again], into[again] = self.rank_of(sym[again], sym[again + 1])
        return total

    def _tokens(self, sym: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        if not len(sym):
            return np.zeros(n, np.int64)
        plain = sym != self.space
        known = np.zeros(len(sym), bool)
        known[sym >= 0] = self.known[sym[sym >= 0]]
        tokens = np.where(known, 1, 0)
        odd = np.flatnonzero(~known)
        if len(odd):
            # characters of the symbol: an unknown one, or a piece part that is no piece itself
            code = np.where(sym[odd] < 0, -1 - sym[odd], 0)
            inner = sym[odd] >= 0
            if inner.any():
                back = dict(zip(self.char_symbol.tolist(), self.char_code.tolist(), strict=True))
                code[inner] = [back[s] for s in sym[odd][inner].tolist()]
            tokens[odd] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        out = np.bincount(word[plain], weights=tokens[plain], minlength=n).astype(np.int64)
        lone = np.flatnonzero(~plain)
        if len(lone):
            head = np.append(True, (np.diff(lone) > 1) | (np.diff(word[lone]) > 0))
            length = np.diff(np.append(np.flatnonzero(head), len(lone)))
            pieces = length // self.space_run + self.space_tokens[length % self.space_run]
            out += np.bincount(word[lone][head], weights=pieces, minlength=n).astype(np.int64)
        return out


class TokenCounter:
    """Counts whole texts; remembers the counts of short pre-tokens between blocks."""

    def __init__(self, path: str):
        self.vocabulary = PieceVocabulary(path)
        self.memo: dict[str, int] = {}

    def __call__(self, texts: list) -> np.ndarray:
        rows = []
        for t in texts:
            t = t.replace(SPACE, " ") if t else ""
            rows.append((_PRE.findall(" " + t) if t else [], t.count("\n")))
        memo = self.memo
        fresh = list({w for words, _ in rows for w in words if w not in memo})
        if len(memo) + len(fresh) > MEMO_WORDS:
            memo.clear()
            fresh = list({w for words, _ in rows for w in words})
        counts = self.vocabulary.count([w.replace(" ", SPACE) for w in fresh])
        memo.update(zip(fresh, counts.tolist(), strict=True))
        get = memo.__getitem__
        out = np.array([sum(map(get, words)) + breaks for words, breaks in rows], np.int64)
        for w in fresh:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out


_COUNTERS: dict[str, TokenCounter] = {}  # per worker process


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, keep: list[str], limit: int = LIMIT) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    ``path``: the model file, readable on the executors.  Null and empty texts have 0 bytes and
    0 tokens; repeated rows are counted one by one; other columns are ignored; an empty table gives
    an empty result.  Texts are counted whole, whatever their length."""

    def make():
        count = counter(path)

        def fn(texts):
            n = count(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            return {"n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array(n > limit, pa.bool_())}

        return fn

    return map_text(docs, keep, "text", "n_bytes long, n_tokens long, over_limit boolean", make)
