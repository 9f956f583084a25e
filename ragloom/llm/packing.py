"""Packing documents into fixed token windows: bounded-space online packing.

Every task keeps at most ``OPEN`` unfinished windows.  A document's ids are cut into
full windows, and the rest goes to the open window that it leaves the smallest gap
in (best fit).  When none fits and no more may be opened, the fullest is topped up
with the head of the rest and emitted.  At the end of a task the emptiest windows
are poured into the fullest, so one unfinished window is left per task; these
leftovers are merged whole, best fit again, in groups of bounded size.

Ids come from the tokenizer's library.  White space always parts tokens, so a text is
looked up word by word in a memo and only new words are encoded.
"""

from __future__ import annotations

import zlib
from array import array
from itertools import chain, pairwise
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import kept, text_blocks

WINDOW = 2048
OPEN = 32                   # open windows per task
END_ID = 1                  # id that closes each document
MERGE_GROUP = 256           # leftover windows merged in one group
MEMO_WORDS = 800_000        # encoded words a worker remembers (speed only)
MEMO_IDS = 16 * MEMO_WORDS  # and their ids together
BASE_WORDS = 200_000        # and normalised words
BATCH = 1024                # texts the library encodes at once
MEMO_CHARS = 64             # longer words go when the memo is renewed

_TAIL = ".,!?;:"


class WordEncoder:
    """Ids of whole texts by the tokenizers library, through a memo of words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # the same model for words that are one normalised pre-token already
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self):
        self.memo: dict[str, int] = {}          # word -> slot
        self.base: dict[str, bytes] = {"": b""}  # normalised word of letters -> ids as bytes (no object per id)
        self.start, self.size, self.pool = array("q"), array("q"), array("I")
        self.hits = np.zeros(0, np.int64)       # uses of each slot

    @staticmethod
    def _ids(tok, texts: list[str]) -> list[list[int]]:
        # the library's encodings are many times their ids
        return [e.ids for i in range(0, len(texts), BATCH) for e in tok.encode_batch_fast(texts[i:i + BATCH], add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encode new words.  A word of letters alone is one pre-token, so many are encoded as one
        text and parted at the ids that end a word; the rest is encoded one by one."""
        if len(self.base) > BASE_WORDS:     # after this, found again as needed
            self.base = {"": b""}
        base, other, parts = self.base, [], []
        for w in words:
            stem = w.rstrip(_TAIL)
            low = stem.lower() if stem.isascii() else normalize("NFC", stem).replace("Σ", "σ").lower()
            if low.isalpha() and len(low) <= MEMO_CHARS:
                parts.append((w, low, w[len(stem):]))
            else:
                other.append(w)     # also the empty string that a double space leaves
        fresh = list({s for _, s, _ in parts if s not in base})
        groups = [fresh[i:i + 512] for i in range(0, len(fresh), 512)]
        for group, ids in zip(groups, self._ids(self.plain, [" ".join(g) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            stop = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(stop) != len(group):
                raise ValueError("a word of letters became several pre-tokens")
            raw = ids.tobytes()
            base.update((g, raw[a:b]) for g, a, b in zip(group, [0, *stop[:-1]], stop, strict=True))
        tails = list({t for _, _, t in parts if t not in base})
        base.update(zip(tails, self._raw(self._ids(self.tok, tails)), strict=True))
        found = [base[s] + base[t] if t else base[s] for _, s, t in parts] + self._raw(self._ids(self.tok, other))
        self.memo.update(zip([w for w, _, _ in parts] + other, range(len(self.start), len(self.start) + len(found)),
                             strict=True))
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.start.frombytes((len(self.pool) + np.cumsum(n) - n).astype(np.int64).tobytes())
        self.size.frombytes(n.tobytes())
        self.pool.frombytes(b"".join(found))

    @staticmethod
    def _raw(ids: list[list[int]]) -> list[bytes]:
        raw = np.fromiter(chain.from_iterable(ids), np.uint32).tobytes()
        end = (4 * np.cumsum([0, *map(len, ids)])).tolist()
        return [raw[a:b] for a, b in pairwise(end)]

    def _renew(self) -> None:
        """When the memo is full, words met more than once since the last time stay, the most frequent half of it at
        most: a stream of new words does not push out the common ones."""
        hits = self.hits
        least = 2
        if len(hits) > MEMO_WORDS // 2:
            least = max(least, int(np.partition(hits, -(MEMO_WORDS // 2))[-(MEMO_WORDS // 2)]) + 1)
        words = [w for w, slot in self.memo.items() if hits[slot] >= least and len(w) <= MEMO_CHARS]
        slots = np.array([self.memo[w] for w in words], np.int64)
        ids, n = self._gather(slots)
        self.clear()
        self.memo = dict(zip(words, range(len(words)), strict=True))
        self.start.frombytes((np.cumsum(n) - n).astype(np.int64).tobytes())
        self.size.frombytes(n.astype(np.int64).tobytes())
        self.pool.frombytes(ids.astype(np.uint32).tobytes())
        self.hits = np.zeros(len(words), np.int64)

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots one behind the other, and the number of ids of each."""
        start, size, pool = (np.frombuffer(x, kind) if len(x) else np.zeros(0, kind)
                             for x, kind in ((self.start, np.int64), (self.size, np.int64), (self.pool, np.uint32)))
        n = size[slots]
        at = np.repeat(start[slots] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return pool[at], n

    def __call__(self, texts: list) -> list[np.ndarray]:
        # the words of a block are told apart by Arrow, so the memo is asked once for each
        rows = pc.split_pattern(pc.replace_substring(pa.array([t or "" for t in texts], pa.string()), "\n", " "), " ")
        coded = rows.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        slots = list(map(self.memo.get, words))
        missing = [i for i, slot in enumerate(slots) if slot is None]
        if missing:
            self._learn([words[i] for i in missing])
            memo = self.memo
            for i in missing:
                slots[i] = memo[words[i]]
        slots = np.array(slots, np.int64)[coded.indices.to_numpy()]
        self.hits = np.bincount(slots, minlength=len(self.start)) + np.pad(self.hits, (0, len(self.start) - len(self.hits)))
        ids, n = self._gather(slots)
        end = np.append(0, np.cumsum(n))[rows.offsets.to_numpy()]
        out = [np.append(ids[a:b], np.uint32(END_ID)) for a, b in pairwise(end.tolist())]
        if len(self.memo) > MEMO_WORDS or len(self.pool) > MEMO_IDS:
            self._renew()
        return out


def encoder(path: str) -> WordEncoder:
    return kept(("words", path), lambda: WordEncoder(path))


class OnlinePacker:
    """Open windows of one task.  Emits (row key, start, ids, document tokens, window, offset)."""

    def __init__(self, window: int = WINDOW, limit: int = OPEN):
        self.window, self.limit, self.open, self.out, self.closed = window, limit, [], [], 0

    def _emit(self, pieces) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.out.append((key, start, ids, total, self.closed, offset))
            offset += len(ids)
        self.closed += 1

    def _put(self, at: int, piece) -> None:
        slot = self.open[at]
        slot[0] += len(piece[2])
        slot[1].append(piece)
        if slot[0] == self.window:
            self._emit(self.open.pop(at)[1])

    def add(self, key, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self._emit([(key, start, ids[start:start + self.window], total)])
            start += self.window
        while start < total:
            rest = total - start
            fits = [(self.window - f, i) for i, (f, _) in enumerate(self.open) if self.window - f >= rest]
            if fits:
                self._put(min(fits)[1], (key, start, ids[start:], total))
                return
            if len(self.open) < self.limit:
                self.open.append([rest, [(key, start, ids[start:], total)]])
                return
            fullest = max(range(len(self.open)), key=lambda i: (self.open[i][0], -i))
            take = self.window - self.open[fullest][0]
            self._put(fullest, (key, start, ids[start:start + take], total))
            start += take

    def finish(self) -> None:
        """Pour the emptiest windows into the fullest; the last unfinished one gets number ``closed``."""
        self.open.sort(key=lambda s: -s[0])
        while len(self.open) > 1:
            key, start, ids, total = self.open[-1][1].pop()
            self.open[-1][0] -= len(ids)
            if not self.open[-1][1]:
                self.open.pop()
            while len(ids) and self.open:
                take = min(len(ids), self.window - self.open[0][0])
                self._put(0, (key, start, ids[:take], total))
                start, ids = start + take, ids[take:]
            if len(ids):
                self.open.append([len(ids), [(key, start, ids, total)]])
        for _, pieces in self.open:
            self._emit(pieces)
        self.open = []


def _merge_leftovers(pdf):
    """Best fit of a group's unfinished windows into sequences, largest first, none cut."""
    import pandas as pd

    room, seq, shift = [], {}, {}
    order = pdf.sort_values(["fill", "part"], ascending=[False, True])
    for part, fill, window in zip(order["part"], order["fill"], order["window"], strict=True):
        fits = [(r, i) for i, (r, _) in enumerate(room) if r >= fill]
        if fits:
            _, i = min(fits)
        else:
            room.append((WINDOW, (int(part) << 32) + int(window)))
            i = len(room) - 1
        left, name = room[i]
        seq[part], shift[part] = name, WINDOW - left
        room[i] = (left - fill, name)
    return pd.DataFrame({"part": list(seq), "merged_id": list(seq.values()), "shift": list(shift.values())})


def pack_documents(docs: DataFrame, path: str, payload: str = "crc") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32 (payload="ids": also ids, the
    piece's little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset.

    ``path``: the tokenizer file, readable on the executors.  A null or empty text is the closing
    id alone.  Repeated rows are packed one by one.  A text of any length is cut into as many
    windows as it needs; an empty table gives an empty result; other columns are ignored.
    The pieces are checkpointed in the shared folder before leftovers are merged, so a lost
    executor cannot change what has been numbered."""
    ids_field = ", ids binary" if payload == "ids" else ""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
              f"part long, window long, offset long{ids_field}")

    def run(batches):
        part = TaskContext.get().partitionId()
        encode, packer = encoder(path), OnlinePacker()

        def rows():
            found, packer.out = packer.out, []
            raw = [p[2].astype("<u4").tobytes() for p in found]
            cols = [pa.array([p[0] for p in found], key_type), pa.array([p[1] for p in found], pa.int64()),
                    pa.array([len(p[2]) for p in found], pa.int64()),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array([p[3] for p in found], pa.int64()),
                    pa.array([part] * len(found), pa.int64()), pa.array([p[4] for p in found], pa.int64()),
                    pa.array([p[5] for p in found], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "offset"]
            if payload == "ids":
                cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(cols, names=names)

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for a, b, (texts,) in text_blocks(batch.column(1)):
                for key, ids in zip(keys[a:b], encode(texts), strict=True):
                    packer.add(key, ids)
                yield rows()
        if key_type is not None:
            packer.finish()
            yield rows()

    ensure_checkpoint_dir(docs.sparkSession)
    pieces = docs.select("doc_id", "text").mapInArrow(run, schema).checkpoint()
    # one unfinished window per task at most: its last
    last = (pieces.groupBy("part", "window").agg(F.sum("length").alias("fill"))
            .filter(F.col("fill") < WINDOW))
    merged = (last.withColumn("grp", F.floor(F.col("part") / MERGE_GROUP)).groupBy("grp")
              .applyInPandas(_merge_leftovers, "part long, merged_id long, shift long"))
    merged = merged.join(last.select("part", "window"), "part")
    out = pieces.join(merged, ["part", "window"], "left")
    extra = ["ids"] if payload == "ids" else []
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("merged_id", F.shiftleft(F.col("part"), 32) + F.col("window")).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"), *extra)
