"""How filters interact: what each of five filters removes at every step of every order.

A document's five verdicts are one cell of a 2x2x2x2x2 table (0 passes, 1 fails, one axis per
filter), so everything that an audit asks of a part is a contraction of that part's counts:
along each axis a step selects ``pass``, ``fail`` or ``all``.  Spark counts the cells (32 a part,
three counts each); all steps of all orders are then one ``einsum`` over the selectors, run on
the executors, part by part.

The only filter that looks beyond its row is E (the text stands under a smaller id).  Texts
travel as digests: the smallest id of each digest is pre-aggregated before the shuffle, and rows
meet it on (digest, id), a key that no group of copies makes hot.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

LETTERS = "ABCDE"
MIN_WORDS = 50                          # A fails under so many words
DISTINCT_PERCENT = 65                   # B fails under so many distinct words in a hundred
UPPER_PERCENT = 5                       # C fails over so many capitals in a hundred characters
SYMBOLS = "[#$%&*|]"                    # D fails on any of these

ORDERS = ["".join(p) for p in permutations(LETTERS)]
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def row_filters(text: Column) -> dict[str, Column]:
    """Failure of the filters that read their own row only (null text: empty)."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))
    return {
        "A": n < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < DISTINCT_PERCENT * n,
        "C": capitals * 100 > UPPER_PERCENT * F.length(whole),
        "D": whole.rlike(SYMBOLS),
    }


def selectors() -> dict[str, np.ndarray]:
    """Per selection, an array (step of an order, axis, 2): what is summed along each axis.
    Steps run through the orders, five each."""
    kept, removed, failing, alone = [], [], [], []
    for order in ORDERS:
        for step, letter in enumerate(order):
            before = order[:step]
            kept.append([PASS if x in before or x == letter else ALL for x in LETTERS])
            removed.append([FAIL if x == letter else PASS if x in before else ALL for x in LETTERS])
            failing.append([FAIL if x == letter else ALL for x in LETTERS])
            alone.append([FAIL if x == letter else PASS for x in LETTERS])
    return {k: np.array(v, np.int64) for k, v in
            {"kept": kept, "removed": removed, "failing": failing, "alone": alone}.items()}


def contract(counts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(parts, 2, 2, 2, 2, 2) and (steps, 5, 2) give (parts, steps)."""
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", counts, *(chosen[:, i] for i in range(5)), optimize="greedy")


def audit_counts(total: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The measures (parts, 600) of per-part cell counts (parts, 32), cell = A + 2 B + 4 C + 8 D + 16 E."""
    # the last axis of the reshaped array is the lowest bit: turned round, A is the first
    cube = [x.reshape(-1, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1) for x in (total, good, toxic)]
    by = selectors()
    removed = contract(cube[0], by["removed"])
    letter = np.array([LETTERS.index(x) for order in ORDERS for x in order])
    of_letter = np.stack([removed[:, letter == i].sum(1) for i in range(5)], 1)
    return {
        "kept": contract(cube[0], by["kept"]),
        "removed": removed,
        "redundant": contract(cube[0], by["failing"]) - removed,
        "unique_fails": contract(cube[0], by["alone"]),
        "good_lost": contract(cube[1], by["removed"]),
        "toxic_lost": contract(cube[2], by["removed"]),
        "shapley": of_letter[:, letter],
    }


def audit_rows(cells: DataFrame) -> DataFrame:
    """part and three arrays of 32 counts -> one row per (part, filter_order, step)."""
    steps = len(ORDERS) * 5

    def run(batches):
        order = pa.array([o for o in ORDERS for _ in range(5)])
        step = pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)))
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(a, 256)
                n = len(part)
                tensors = [batch.column(i).slice(a, 256).flatten().to_numpy().reshape(n, 32) for i in (1, 2, 3)]
                got = audit_counts(*tensors)
                cols = [part.take(pa.array(np.repeat(np.arange(n), steps))),
                        pa.chunked_array([order] * n).combine_chunks(),
                        pa.chunked_array([step] * n).combine_chunks(),
                        *(pa.array(got[m].reshape(-1).astype(np.int64)) for m in MEASURES)]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "filter_order", "step", *MEASURES])

    return cells.select("part", "total", "good", "toxic").mapInArrow(
        run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per (part, filter_order, step): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic; further columns are ignored.  A null
    text is empty, a null source is the part ''.  A null doc_id is greater than every other: such a row fails E
    if its text stands under any id, and no label belongs to it.  Rows that repeat an id count one by one, and
    equal texts under one id do not fail E for each other.  Several labels of one id count once, as 1 if any
    is 1; a document without a label is neither good nor toxic.  An empty table gives an empty result."""
    spark = docs.sparkSession
    fails = row_filters(F.col("text"))
    mask = sum(((F.when(fails[x], 1 << i).otherwise(0)) for i, x in enumerate("ABCD")), F.lit(0))
    path = scratch_path(spark, "filter-audit")
    docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"),
        mask.cast("byte").alias("mask"),
    ).write.parquet(path)
    rows = spark.read.parquet(path)

    first = rows.groupBy("digest").agg(F.min("id").alias("first"))
    marks = (labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").filter("id IS NOT NULL")
             .groupBy("id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                                F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    r, f, m = rows.alias("r"), first.alias("f"), marks.alias("m")
    cell = (r.join(f, (F.col("r.digest") == F.col("f.digest")) & F.col("r.id").eqNullSafe(F.col("f.first")), "left")
            .join(m, F.col("r.id") == F.col("m.id"), "left")
            .select("r.part", (F.col("r.mask") + F.when(F.col("f.digest").isNull(), 16).otherwise(0)).alias("cell"),
                    F.coalesce("m.good", F.lit(0)).alias("good"), F.coalesce("m.toxic", F.lit(0)).alias("toxic"))
            .groupBy("part", "cell").agg(F.count(F.lit(1)).alias("total"), F.sum("good").alias("good"),
                                         F.sum("toxic").alias("toxic")))

    def at_cell(name: str) -> Column:
        return F.array(*(F.sum(F.when(F.col("cell") == c, F.col(name)).otherwise(F.lit(0).cast("long")))
                         for c in range(32))).alias(name)

    return audit_rows(cell.groupBy("part").agg(*(at_cell(x) for x in ("total", "good", "toxic"))))


ORACLE = """
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
first AS (SELECT body, min(doc_id) AS first FROM words GROUP BY body),
mark AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
doc AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 5 * length(body)
                 THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN words.doc_id IS DISTINCT FROM first THEN 'E' ELSE '' END AS fails
  FROM words JOIN first USING (body) LEFT JOIN mark ON words.doc_id = mark.doc_id),
cell AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM doc GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
perm AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
step AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS x, substr(filter_order, 1, s - 1) AS earlier
         FROM perm, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
seen AS (
  SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS failing, fails = x AS alone,
         length(translate(fails, earlier, '')) < length(fails) AS gone
  FROM step, cell),
counted AS (
  SELECT part, filter_order, step, x,
         coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept,
         coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
         coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""
