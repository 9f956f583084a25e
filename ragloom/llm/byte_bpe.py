"""Byte-level BPE encoding and decoding of whole texts, split without a pattern engine.

Pre-tokens.  A block of texts is one array of code points, each mapped to a class: letter, number,
white space, other, and the few classes that a look at the next characters makes of an apostrophe
or of white space.  The split rule is then a finite automaton over classes.  A class is a function
from state to state; functions compose associatively and all their compositions form a small
table (``Splitter.product``), so the state before every character comes from a prefix scan of
function numbers: within rows of the block side by side, then over the row totals by doubling.  A
class that ends a text sets the state back, so texts do not affect each other.

Merging.  Slices between boundaries are looked up in a memo of merged pre-tokens; a new one is
merged by rank (pairs lowest rank first, leftmost first), long ones with a heap of pairs.

Decoding.  Every vocabulary entry is a slice of one byte array; ids give slices, which are
gathered in one step, and the token offsets cut the result into texts again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text

MEMO_WORDS = 500_000        # merged pre-tokens a worker remembers (speed only)
MEMO_IDS = 16 * MEMO_WORDS  # and their ids together
MEMO_BYTES = 64             # longer pre-tokens go at the next clearing
HEAP_BYTES = 96             # longer pre-tokens are merged with a heap
SIDE_BY_SIDE = 1024         # short pre-tokens merged at once
NEVER = 1 << 40             # rank of a pair that is no entry
ROW = 512                   # characters of a scan row

# classes of characters; the last four depend on what follows
END, LETTER, NUMBER, OTHER, SHORT, LONG, GLUE, BREAK, SPACE = range(9)
# states: what the last token can still take
NOTHING, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_GLUE, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
STATES, CLASSES = 8, 9
TEXT_END = 0x110000         # stands behind every text; no code point

SHORT_ENDINGS = "stmd"                      # 's 't 'm 'd
LONG_ENDINGS = ("re", "ve", "ll")           # 're 've 'll


def _step(state: int, cls: int) -> tuple[int, bool]:
    """The state behind a character, and whether a token starts at it."""
    if cls == END:
        return NOTHING, False
    if cls == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):                   # letters of a contraction
            return (NOTHING if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, IN_GLUE)
    if cls == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, IN_GLUE)
    if cls in (OTHER, SHORT, LONG):
        if state in (IN_OTHER, IN_GLUE):                    # an apostrophe within a run is nothing special
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT: ONE_LEFT, LONG: TWO_LEFT}[cls], True
    if cls == GLUE:                                         # the blank before a word goes with it
        return IN_GLUE, True
    if cls == BREAK:                                        # other white space before a word stands alone
        return NOTHING, True
    return IN_SPACE, state != IN_SPACE


class Splitter:
    """Pre-token boundaries of code point arrays."""

    def __init__(self):
        self.kind = character_kinds()
        moves = [tuple(_step(s, c)[0] for s in range(STATES)) for c in range(CLASSES)]
        # cuts: where a token starts, and at every end
        self.starts = np.array([[_step(s, c)[1] or c == END for c in range(CLASSES)] for s in range(STATES)])
        # every composition of class functions has a number; 0 is the identity
        number = {tuple(range(STATES)): 0}
        functions = list(number)
        for f in functions:                                 # grows while it is walked
            for m in moves:
                g = tuple(m[x] for x in f)
                if g not in number:
                    number[g] = len(functions)
                    functions.append(g)
        self.of_class = np.array([number[m] for m in moves], np.uint8)
        self.apply = np.array(functions, np.int64)          # (function, state) -> state
        size = len(functions)
        self.size = size
        self.product = np.array([number[tuple(g[x] for x in f)] for f in functions for g in functions])

    def classes(self, code: np.ndarray) -> np.ndarray:
        """Class of every code point; TEXT_END marks the end of a text."""
        cls = self.kind[code]
        space = cls == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & (cls[1:] != END))       # in front of a word
        cls[last] = np.where(code[last] == 0x20, GLUE, BREAK)
        quote = np.flatnonzero(code == ord("'"))
        if len(quote):
            ahead = np.append(code, [TEXT_END, TEXT_END])
            one, two = ahead[quote + 1], ahead[quote + 2]
            short = np.isin(one, [ord(x) for x in SHORT_ENDINGS])
            long = np.zeros(len(quote), bool)
            for x, y in LONG_ENDINGS:
                long |= (one == ord(x)) & (two == ord(y))
            cls[quote[short]] = SHORT
            cls[quote[long]] = LONG
        return cls

    def states(self, cls: np.ndarray) -> np.ndarray:
        """State before every character, by a scan over the functions of the classes."""
        n = len(cls)
        rows = -(-n // ROW)
        f = np.zeros(rows * ROW, np.uint8)                  # filled up with the identity
        f[:n] = self.of_class[cls]
        f = np.ascontiguousarray(f.reshape(rows, ROW).T)    # line j: the j-th character of every row
        prefix = np.zeros((ROW, rows), np.uint8)
        now = np.zeros(rows, np.int64)                      # composition of the row so far
        for j in range(ROW):
            prefix[j] = now
            now *= self.size
            now += f[j]
            now = self.product.take(now)
        gap = 1
        while gap < rows:                                   # inclusive scan of the row totals by doubling
            now[gap:] = self.product[now[:-gap] * self.size + now[gap:]]
            gap *= 2
        before = np.append(0, now[:-1])                     # everything in front of the row
        start = self.apply[before, NOTHING]
        at = prefix.T.astype(np.int64) * STATES
        at += start[:, None]
        return self.apply.reshape(-1).take(at.reshape(-1)[:n])

    def boundaries(self, code: np.ndarray) -> np.ndarray:
        """Indexes at which a pre-token starts or a text ends."""
        if not len(code):
            return np.zeros(0, np.int64)
        cls = self.classes(code)
        at = self.states(cls)
        at *= CLASSES
        at += cls
        return np.flatnonzero(self.starts.reshape(-1).take(at))


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point, by the Unicode tables of the library
    whose ids are to be met (a probe vocabulary keeps only what a property matches)."""
    import tiktoken

    plane = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    kind = np.full(TEXT_END + 1, OTHER, np.int8)
    kind[TEXT_END] = END
    for prop, value in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        probe = tiktoken.Encoding(f"kind {value}", pat_str=prop, special_tokens={},
                                  mergeable_ranks={bytes([i]): i for i in range(256)})
        found = bytes(probe.encode_ordinary(plane)).decode("utf-8")
        kind[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    return kind


class ByteVocabulary:
    """Ranks of a vocabulary file (base64 token and rank on each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if any(bytes([i]) not in self.rank for i in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        size = max(self.rank.values()) + 1
        entries = [b""] * size
        for token, rank in self.rank.items():
            entries[rank] = token
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        rank = self.rank
        self.single = np.array([rank[bytes([i])] for i in range(256)], np.int64)
        self.pair_width = size
        pairs = sorted((rank[t[:c]] * size + rank[t[c:]], r) for t, r in rank.items() for c in range(1, len(t))
                       if t[:c] in rank and t[c:] in rank)
        self.pair_key = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.pair_value = np.array([r for _, r in pairs] + [0], np.int64)
        self.decimal = [str(i) for i in range(size)]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token: short ones side by side, long ones by a heap."""
        out: list[list[int]] = [[]] * len(words)
        short = []
        for i, w in enumerate(words):
            whole = self.rank.get(w)
            if whole is not None:
                out[i] = [whole]
            elif len(w) > HEAP_BYTES:
                out[i] = self._merge_long(w)
            else:
                short.append(i)
        short.sort(key=lambda i: len(words[i]))
        for a in range(0, len(short), SIDE_BY_SIDE):
            part = short[a:a + SIDE_BY_SIDE]
            for i, ids in zip(part, self._merge_short([words[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _merge_short(self, words: list[bytes]) -> list[list[int]]:
        """In every round each word merges its pair of lowest rank, the leftmost of them."""
        n, wide = len(words), max(map(len, words)) + 1
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(n, wide)
        inside = np.arange(wide) < np.array([len(w) for w in words])[:, None]
        sym = np.where(inside, self.single[raw], -1).astype(np.int64)
        rank = np.full((n, wide), NEVER)
        rank[:, :-1] = self.pair_rank(sym[:, :-1], sym[:, 1:])
        after = np.tile(np.arange(1, wide + 1), (n, 1))     # the last column is an empty symbol behind every word
        before = after - 2
        row = np.arange(n)
        while True:
            at = rank[row].argmin(1)
            low = rank[row, at]
            row, at, low = row[low < NEVER], at[low < NEVER], low[low < NEVER]
            if not len(row):
                break
            gone = after[row, at]
            sym[row, at] = low                              # an id is the rank of its bytes
            sym[row, gone], rank[row, gone] = -1, NEVER
            new = after[row, gone]
            after[row, at], before[row, new] = new, at
            rank[row, at] = self.pair_rank(low, sym[row, new])
            left = before[row, at]
            r, x = row[left >= 0], left[left >= 0]
            rank[r, x] = self.pair_rank(sym[r, x], low[left >= 0])
        alive = sym >= 0
        flat, size = sym[alive].tolist(), np.cumsum(alive.sum(1)).tolist()
        return [flat[a:b] for a, b in itertools.pairwise([0, *size])]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of two neighbours joined (NEVER, where that is no entry or one is missing, i.e. negative)."""
        key = left * self.pair_width + right
        at = np.searchsorted(self.pair_key, key)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_value[at], NEVER)

    def _merge_long(self, word: bytes) -> list[int]:
        """The same by a heap of pairs over a linked list: n log n for a run of any length."""
        rank, n = self.rank, len(word)
        end = list(range(1, n + 1))             # a part starts at i and ends before end[i]
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue                        # one of its parts has changed
            gone = end[i]
            alive[gone], end[i] = False, stop
            if stop < n:
                before[stop] = i
            for a in (i, before[i]):
                if a >= 0 and end[a] < n:
                    b = end[end[a]]
                    r = rank.get(word[a:b])
                    if r is not None:
                        heapq.heappush(heap, (r, a, b))
        return [rank[word[i:end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of consecutive texts; text i has the ids before ends[i] that no earlier text has."""
        size = self.length[ids]
        stop = np.cumsum(size)
        take = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.start[ids] - (stop - size), size)
        flat = self.flat[take].tobytes()
        cut = np.append(0, stop)[np.append(0, ends)].tolist()
        return [flat[a:b] for a, b in itertools.pairwise(cut)]


class Memo:
    """Merged pre-tokens: a row number per word, the ids of all rows in one array.

    When it is full, words met more than once since the last clearing stay (at most half of it, the most
    frequent), so a stream of new words does not push out the common ones."""

    def __init__(self):
        self.row: dict[bytes, int] = {}
        self.ids = array("i")
        self.size = array("i")
        self.hits = np.zeros(0, np.int64)

    def add(self, word: bytes, ids: list[int]) -> int:
        at = self.row[word] = len(self.size)
        self.ids.extend(ids)
        self.size.append(len(ids))
        return at

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one behind the other, and the number of ids of each."""
        size = np.array(self.size, np.int64)
        start = np.cumsum(size) - size
        self.hits = np.bincount(rows, minlength=len(size)) + np.pad(self.hits, (0, len(size) - len(self.hits)))
        n = size[rows]
        take = np.repeat(start[rows] - (np.cumsum(n) - n), n)
        take += np.arange(len(take))
        return np.array(self.ids, np.int64)[take], n

    def tidy(self) -> None:
        """Called between blocks: bounds the memo."""
        if len(self.row) <= MEMO_WORDS and len(self.ids) <= MEMO_IDS:
            return
        words = [w for w in self.row if len(w) <= MEMO_BYTES]
        hits = self.hits[[self.row[w] for w in words]]
        least = 2
        if len(words) > MEMO_WORDS // 2:
            least = max(least, int(np.partition(hits, -(MEMO_WORDS // 2))[-(MEMO_WORDS // 2)]) + 1)
        words = [w for w, k in zip(words, hits.tolist(), strict=True) if k >= least]
        rows = np.array([self.row[w] for w in words], np.int64)
        ids, n = self.gather(rows)
        self.row = dict(zip(words, range(len(words)), strict=True))
        self.ids, self.size = array("i", ids.tolist()), array("i", n.tolist())
        self.hits = np.zeros(len(words), np.int64)


class ByteBPE:
    """Encoder and decoder; remembers merged pre-tokens between blocks."""

    def __init__(self, path: str):
        self.vocabulary = ByteVocabulary(path)
        self.splitter = Splitter()
        self.memo = Memo()

    def pretokens(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """UTF-8 slices of all texts and, per text, the number of slices up to its end."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        stop = TEXT_END.to_bytes(4, "little")
        code = np.frombuffer(b"".join(x for t in texts for x in (t.encode("utf-32-le", "surrogatepass"), stop)), np.uint32)
        at = self.splitter.boundaries(code)
        is_end = code[at] == TEXT_END
        # bytes before every code point; an end has none
        width = np.ones(len(code), np.int8)
        for least in (0x80, 0x800, 0x10000):
            width += code >= least
        width[at[is_end]] = 0
        cut = (np.cumsum(width, dtype=np.int64) - width)[at]
        flat = b"".join(data)
        start = np.flatnonzero(~is_end)
        words = [flat[a:b] for a, b in zip(cut[start].tolist(), cut[start + 1].tolist(), strict=True)]
        return words, np.cumsum(~is_end)[is_end]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and, per text, the number of ids up to its end."""
        words, ends = self.pretokens(texts)
        memo, known, merge = self.memo, self.memo.row, self.vocabulary.merge
        rows = list(map(known.get, words))
        missing = [i for i, r in enumerate(rows) if r is None]
        new = list(dict.fromkeys(words[i] for i in missing))
        for word, got in zip(new, merge(new), strict=True):
            memo.add(word, got)
        for i in missing:
            rows[i] = known[words[i]]
        ids, size = memo.gather(np.array(rows, np.int64))
        memo.tidy()
        return ids, np.append(0, np.cumsum(size))[ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        return self.vocabulary.decode(ids, ends)


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBPE:
    """One per worker process and vocabulary file."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``ids`` and ``starts`` (the byte of the text at which each token starts) of every row.

    ``path``: the vocabulary file, readable on the executors.  Null and empty texts have no token; repeated rows
    are encoded one by one; other columns are ignored; an empty table gives an empty result.  Texts are encoded
    whole, whatever their length."""

    def make():
        bpe = codec(path)

        def fn(texts):
            ids, ends = bpe.encode([t or "" for t in texts])
            size = bpe.vocabulary.length[ids]
            offset = np.append(0, ends).astype(np.int32)
            stop = np.append(0, np.cumsum(size))
            begin = stop[:-1] - np.repeat(stop[offset[:-1]], np.diff(offset))
            return {"ids": pa.ListArray.from_arrays(offset, pa.array(ids.astype(np.int32))),
                    "starts": pa.ListArray.from_arrays(offset, pa.array(begin, pa.int64()))}

        return fn

    return map_text(docs, keep, "text", "ids array<int>, starts array<long>", make)


def decode_documents(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``bytes``, the decoded text of ``ids`` (null or empty ids: no byte)."""
    fields = ", ".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        vocabulary = codec(path).vocabulary
        for batch in batches:
            lists = batch.column(len(keep))
            ids = lists.flatten().to_numpy().astype(np.int64)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            text = vocabulary.decode(ids, np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(text, pa.binary())],
                                             names=[*keep, "bytes"])

    return encoded.select(*keep, "ids").mapInArrow(run, f"{fields}, bytes binary" if keep else "bytes binary")


def encoding_digests(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the
    bytes that the ids decode to); rows as for ``encode_documents``, without moving the ids between processes."""

    def make():
        bpe = codec(path)

        def fn(texts):
            ids, ends = bpe.encode([t or "" for t in texts])
            decoded = bpe.decode(ids, ends)
            number = ids.tolist()
            cut = [0, *ends.tolist()]
            decimal = bpe.vocabulary.decimal.__getitem__
            said = [hashlib.sha256(",".join(map(decimal, number[a:b])).encode()).hexdigest()
                    for a, b in itertools.pairwise(cut)]
            return {"n_tokens": pa.array(np.diff(cut), pa.int64()), "ids_sha256": pa.array(said, pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in decoded], pa.string())}

        return fn

    return map_text(docs, keep, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
