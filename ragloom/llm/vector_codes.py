"""Vector codes: product codebooks over integer vectors, every distance exact.

Components become integers, vectors are cut into equal consecutive parts, and each part's codebook
is refined by rounds of assignment and floored means.  Assignment is a matrix product: of
``|x - c|^2 = |x|^2 - 2 x.c + |c|^2`` only ``x.c`` needs one.  Integers are split into limbs of so
few bits that a float64 product of two limbs, summed along a part, stays under 2^53 and is exact;
the limb products are recombined in int64, and the first smallest distance decides.

A round is one Spark job: tasks hold the codebooks (their size is set by the parameters and the
vector width), add up what they assign, and send one row per component of each entry they met; Spark adds these
up as decimals.  The driver holds codebooks only.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 4096.0
PARTS, ENTRIES, ROUNDS = 8, 16, 6
EXACT = 53                      # bits that a float64 holds exactly
BLOCK_CELLS = 1 << 21           # components handed to one matrix product
SUM_BITS = 62                   # sums travel as longs of so many bits
LARGE = (1 << 63) - 1           # an error beyond a long is reported as this

def limb_bits(width: int) -> int:
    """Bits a limb may have so that ``width`` products of two limbs add up exactly in float64."""
    return (EXACT - max(1, width).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 arrays, lowest first, with sum(limb << bits * i) = x; all but the last are not negative."""
    out = []
    while x.size and (int(x.max()) >= 1 << bits or int(x.min()) < -(1 << bits)):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def inner_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of int64 arrays, exact while the products fit int64 (partial sums may wrap)."""
    bits = limb_bits(x.shape[1])
    out = np.zeros((len(x), len(c)), np.int64)
    right = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            if bits * (i + j) < 64:
                out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry and the squared distance, for every row of ``x``.

    Values too large for that in int64 (with room for a sum over 256 parts) go through Python integers."""
    peak = max((abs(int(v)) for y in (x, c) if y.size for v in (y.max(), y.min())), default=0)
    if 4 * peak * peak * max(1, x.shape[1]) >= 1 << 55:
        x, c = x.astype(object), c.astype(object)
        gap = np.stack([((x - e) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), object) for e in c], 1)
    else:
        x, c = x.astype(np.int64), c.astype(np.int64)
        gap = (x * x).sum(1)[:, None] - 2 * inner_products(x, c) + (c * c).sum(1)
    at = gap.argmin(1)
    return at, gap[np.arange(len(x)), at]


def floored(x: np.ndarray) -> np.ndarray:
    """floor(4096 x) as integers: int64, or Python integers where that is too small."""
    y = np.floor(SCALE * x.astype(np.float64))
    if y.size and max(-y.min(), y.max()) >= 2.0 ** 62:
        # 4096 x may itself be beyond a double: through the exact integer ratio of x
        flat = [(p * int(SCALE)) // q for p, q in (v.as_integer_ratio() for v in x.astype(np.float64).reshape(-1).tolist())]
        return np.array(flat, object).reshape(x.shape)
    return y.astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Python integers as int64 where they fit."""
    return x.astype(np.int64) if all(abs(v) < 1 << 62 for v in x.reshape(-1)) else x


class Codebooks:
    """One (entries, width / parts) integer array per part."""

    def __init__(self, start: np.ndarray, parts: int = PARTS):
        """``start``: the whole vectors whose parts are the first entries."""
        self.width = start.shape[1]
        self.entries = np.split(start, parts, axis=1)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, parts) and squared distances summed over the parts."""
        codes = np.zeros((len(x), len(self.entries)), np.int64)
        error = np.zeros(len(x), object if x.dtype == object else np.int64)
        for p, (piece, book) in enumerate(zip(np.split(x, len(self.entries), axis=1), self.entries, strict=True)):
            codes[:, p], gap = nearest(piece, book)
            error = error + gap         # int64 stays int64; Python integers where a part needed them
        return codes, error

    def digest(self) -> str:
        flat = ",".join(str(int(v)) for book in self.entries for v in book.reshape(-1))
        return hashlib.sha256(flat.encode()).hexdigest()


def _kept(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & ~bad)


def _integers(column: pa.Array, width: int):
    """Blocks (first row, integer matrix) of a list column, rows padded with zeros to ``width``."""
    step = max(1, BLOCK_CELLS // max(1, width))
    for a in range(0, len(column), step):
        part = column.slice(a, step)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        size = part.value_lengths().to_numpy()
        if (size == width).all():
            yield a, floored(flat.reshape(len(part), width))
        else:
            full = np.zeros((len(part), width), flat.dtype)
            row = np.repeat(np.arange(len(part)), size)
            full[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            yield a, floored(full)


def _smallest(n: int, batches):
    """The task's n smallest distinct values."""
    best = np.zeros(0, np.int64)
    for batch in batches:
        best = np.unique(np.concatenate([best, batch.column(0).to_numpy()]))[:n]
    yield pa.RecordBatch.from_arrays([pa.array(best)], names=["vec_id"])


def _sums(books: Codebooks, batches):
    """One row per (part, entry, position) that the task met and limb of its sum (one, unless the sum is past
    ``SUM_BITS``): the limb and the number of members."""
    parts, sums, counts = len(books.entries), {}, {}
    for batch in batches:
        for _, x in _integers(batch.column(0), books.width):
            codes, _ = books.assign(x)
            for p, piece in enumerate(np.split(x, parts, axis=1)):
                order = np.argsort(codes[:, p], kind="stable")
                used, at, n = np.unique(codes[order, p], return_index=True, return_counts=True)
                # Python integers from here on: a task may add up any number of blocks
                total = np.add.reduceat(piece[order], at, axis=0).astype(object)
                for e, t, k in zip(used.tolist(), total, n.tolist(), strict=True):
                    sums[p, e] = sums[p, e] + t if (p, e) in sums else t
                    counts[p, e] = counts.get((p, e), 0) + k
    rows = [(p, e, i, k, limb, counts[p, e]) for (p, e), t in sums.items() for i, v in enumerate(t)
            for k, limb in enumerate(_long_limbs(int(v)))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                         names=["part", "entry", "pos", "limb", "total", "members"])


def _long_limbs(v: int) -> list[int]:
    out = []
    while not -(1 << SUM_BITS) <= v < 1 << SUM_BITS:
        out.append(v & ((1 << SUM_BITS) - 1))
        v >>= SUM_BITS
    return [*out, v]


def _codes(books: Codebooks, sha: str, n_keep: int, batches):
    for batch in batches:
        for a, x in _integers(batch.column(n_keep), books.width):
            codes, error = books.assign(x)
            hexed = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            cols = [batch.column(i).slice(a, len(x)) for i in range(n_keep)]
            cols += [pa.array(hexed, pa.string()),
                     pa.array([min(int(e), LARGE) for e in error.tolist()], pa.int64()),
                     pa.array([sha] * len(x), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:n_keep], "code", "error",
                                                          "codebooks_sha256"])


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the kept vectors: one scan for the first entries, one per round."""
    kept = _kept(vectors)
    width = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-width // parts) * parts
    # every task sends its smallest ids, so only ``entries`` ids a task are shuffled
    kept = kept.withColumn("vec_id", F.col("vec_id").cast("long"))
    ids = kept.filter(F.col("vec_id").isNotNull()).select("vec_id")
    small = ids.mapInArrow(partial(_smallest, entries), ids.schema).distinct().orderBy("vec_id").limit(entries)
    first = (kept.filter(F.col("vec_id").isin([r[0] for r in small.collect()]))
             .groupBy("vec_id").agg(F.min("embedding")).orderBy("vec_id"))
    start = [floored(np.array([*v, *[0.0] * (width - len(v))], np.float64)) for _, v in first.collect()]
    books = Codebooks(np.stack(start) if start else np.zeros((1, width), np.int64), parts)
    for _ in range(rounds):
        got = (kept.select("embedding").mapInArrow(
                    partial(_sums, books), "part long, entry long, pos long, limb long, total long, members long")
               .groupBy("part", "entry", "pos", "limb")
               .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members")))
        fresh = [book.astype(object) for book in books.entries]
        total: dict[tuple, list] = {}
        for r in got.collect():         # parts x entries x width / parts sums
            total.setdefault((r.part, r.entry, r.pos), []).append((r.limb, int(r.total), r.members))
        for (p, e, i), limb in total.items():       # every task that met an entry sent its lowest limb
            fresh[p][e, i] = sum(t << (SUM_BITS * k) for k, t, _ in limb) // max(m for k, _, m in limb if k == 0)
        books.entries = [_narrow(book) for book in fresh]
    return books


def vector_codes(vectors: DataFrame, keep: list[str], group: str | None = None, parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``keep`` columns, code, error, codebooks_sha256 and, with ``group``, <group>_error of every kept vector.

    Vectors that are null or hold a null or non-finite component are left out.  Vectors shorter than the longest
    one, rounded up to a multiple of ``parts``, are filled up with zeros.  The codebooks start as the vectors of the
    ``entries`` smallest ids (fewer, if there are fewer; a null id starts none, but its vector is assigned and
    counted; of several vectors under one id the smallest starts).  Repeated rows count one by one.  Errors past a
    long are reported as its greatest value.  No kept vector: no row."""
    if not (0 < entries <= 256 and 0 < parts <= 256):
        raise ValueError("two hex digits hold at most 256 entries; sums have room for 256 parts")
    books = fit_codebooks(vectors, parts, entries, rounds)
    names = list(dict.fromkeys([*keep, *([group] if group else [])]))
    own = T.StructType([T.StructField(f"k{i}", vectors.schema[c].dataType) for i, c in enumerate(names)]
                       + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
                          T.StructField("codebooks_sha256", T.StringType())])
    coded = _kept(vectors).select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)), "embedding").mapInArrow(
        partial(_codes, books, books.digest(), len(names)), own)
    out: list[Column] = [F.col(f"c.k{names.index(k)}").alias(k) for k in keep]
    out += [F.col("c.code"), F.col("c.error")]
    joined = coded.alias("c")
    if group:
        key = f"k{names.index(group)}"
        total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGE).cast("decimal(38,0)"))
        whole = coded.groupBy(F.col(key).alias("g")).agg(total.cast("long").alias("group_error"))
        joined = joined.join(whole.alias("w"), F.col(f"c.{key}").eqNullSafe(F.col("w.g")))
        out.append(F.col("w.group_error").alias(f"{group}_error"))
    return joined.select(*out, F.col("c.codebooks_sha256"))


def _round_sql(i: int, last: bool) -> str:
    """Assignment to the codebooks b<i>; unless it is the last, the next codebooks."""
    text = f"""
d{i} AS MATERIALIZED (
  SELECT v.row_id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS gap
  FROM v JOIN b{i} b ON v.part = b.part AND v.pos = b.pos GROUP BY v.row_id, v.part, b.entry),
a{i} AS MATERIALIZED (
  SELECT row_id, part, arg_min(entry, gap * 64 + entry) AS entry, min(gap) AS gap FROM d{i} GROUP BY row_id, part)"""
    if last:
        return text
    return text + f""",
m{i} AS MATERIALIZED (
  SELECT v.part, a.entry, v.pos, sum(v.x)::BIGINT AS s, count(*)::BIGINT AS n
  FROM v JOIN a{i} a ON v.row_id = a.row_id AND v.part = a.part GROUP BY v.part, a.entry, v.pos),
b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x
  FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""


ORACLE = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label, embedding
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (
  SELECT row_id, ((i - 1) * 8) // len(embedding) AS part, (i - 1) % (len(embedding) // 8) AS pos,
         floor(4096 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT row_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT part, row_id - 1 AS entry, pos, x FROM v WHERE row_id <= 16),""" + ",".join(
    _round_sql(i, i == ROUNDS) for i in range(ROUNDS + 1)) + f""",
coded AS (
  SELECT row_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY row_id),
sha AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row_id), sha
"""
