"""Mixing sources to target weights by a low-discrepancy schedule.

Native Spark only.  Slot i of the mix carries the golden-ratio point i * phi mod 1;
cumulative target shares map it to a source.  Every source's documents are laid end
to end in hash order and cut into blocks of equally many words; a source's r-th slot
takes its block r modulo the number of blocks, so any prefix of the mix holds the
sources close to their shares.

A source's last block is short, and a small source is due only a few slots.  Where
slots of whole blocks miss a source's target by more than ``MISS`` or leave the source
out, it is laid out word by word instead: its documents repeat end to end up to the target, cut into
blocks that are spread evenly over the slots.

Ranks and running sums are computed in two levels (bounded groups plus a prefix sum
over group totals), so a source that holds most rows is no single task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import carried, one_of_each

BLOCK_WORDS = 2048          # longest block ...
LEAST_SLOTS = 1 << 16       # ... shorter where the mix would have fewer slots than this
MAX_PASSES = 3              # times a source, and so a document, may be repeated
MISS = (3, 0.01)            # words and share of the target that whole blocks may miss
WEIGHTS = 3                 # sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ...

# Points are multiples of the golden ratio on a grid of 2**31.
GRID = 1 << 31
GOLDEN = 1327217885
CELLS = 1 << 14             # equal cells that turn the point-to-interval lookup into an equi-join
CHUNK = 4096                # slots ranked together


@dataclass
class Mix:
    """sources: idx, source, weight, source_size, target, exact (words of a source laid out word by word, else
    null); stream: every document with its source and word position; rows: the mix itself, one row per slot and
    document piece, where pieces of sources laid out word by word share slots with others."""
    sources: DataFrame
    stream: DataFrame
    rows: DataFrame
    block_words: int


def count_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(parts, "")).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source idx (code point order, null last, from 0), weight, source_size and target.

    Shares by weight of the total; a share above MAX_PASSES times its source is cut to that and the
    excess goes to the others by weight.  With sources sorted by limit / weight the cut ones are a
    prefix; the level left for the rest rises while sources are cut that lie below it and falls
    afterwards, so the common level is the greatest over all prefixes.  One row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("idx", (F.row_number().over(by_name) - 1).cast("bigint"))
    per = (per.withColumn("weight", F.col("idx") % WEIGHTS + 1)
           .withColumn("most", F.col("source_size") * MAX_PASSES))
    by_level = W.orderBy(F.col("most") / F.col("weight"), "idx")
    before, every = by_level.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    cut = F.coalesce(F.sum("most").over(before), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", (F.sum("source_size").over(every) - cut).cast("double") / rest)
    per = per.withColumn("common", F.max("level").over(every))
    return per.select("idx", "source", "weight", "source_size",
                      F.least(F.col("most").cast("double"), F.col("common") * F.col("weight")).alias("target"))


def document_stream(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its source's idx and ``at``, the words before it in its source's hash order."""
    df = sizes.join(sources.select("idx", "source", "source_size", "target", "exact"),
                    sizes["source"].eqNullSafe(sources["source"])).drop("source")
    df = df.withColumn("order_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    df = df.withColumn("bucket", F.substring("order_key", 1, 3))
    total = df.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(W.partitionBy("idx").orderBy("bucket")) - F.col("n")
    total = total.withColumn("before", before).drop("n")
    inside = F.sum("size").over(W.partitionBy("idx", "bucket").orderBy("order_key", "doc_id", "size", "content")
                                .rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return (df.withColumn("inside", inside).join(total, ["idx", "bucket"])
            .withColumn("at", F.col("before") + F.col("inside"))
            .drop("order_key", "bucket", "before", "inside"))


def slot_schedule(spark, sources: DataFrame, total: int, block_words: int) -> DataFrame:
    """slot, idx, pass, block: which block of which source each slot of the mix takes."""
    by_idx = W.orderBy("idx")
    cum = F.sum("target").over(by_idx.rowsBetween(W.unboundedPreceding, 0))
    edge = F.floor(cum / F.lit(float(max(total, 1))) * F.lit(float(GRID))).cast("bigint")
    last = F.col("idx") == F.max("idx").over(W.partitionBy(F.lit(1)))
    spans = (sources.withColumn("hi", F.when(last, F.lit(GRID)).otherwise(F.least(edge, F.lit(GRID))))
             .withColumn("lo", F.coalesce(F.lag("hi").over(by_idx), F.lit(0)))
             .filter((F.col("hi") > F.col("lo")) & (F.col("source_size") > 0))
             .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("bigint")))
    width = GRID // CELLS
    spans = spans.select("idx", "lo", "hi", "blocks", F.explode(F.sequence(
        F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    slots = (spark.range(-(-total // block_words)).withColumnRenamed("id", "slot")
             .withColumn("point", (F.col("slot") % GRID) * GOLDEN % GRID)
             .withColumn("cell", F.floor(F.col("point") / width)))
    slots = (slots.join(spans, "cell").filter((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
             .select("slot", "idx", "blocks", F.floor(F.col("slot") / CHUNK).alias("chunk")))
    count = slots.groupBy("idx", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("idx").orderBy("chunk")) - F.col("n")
    count = count.withColumn("before", before).drop("n")
    rank = F.row_number().over(W.partitionBy("idx", "chunk").orderBy("slot")) - 1
    return (slots.withColumn("rank", rank).join(count, ["idx", "chunk"])
            .withColumn("rank", F.col("rank") + F.col("before"))
            .filter(F.col("rank") < F.col("blocks") * MAX_PASSES)
            .select("slot", "idx", F.floor(F.col("rank") / F.col("blocks")).alias("pass"),
                    (F.col("rank") % F.col("blocks")).alias("block")))


def exact_sources(sources: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """``sources`` with ``exact``, the target in whole words where the slots miss it by more than MISS or give nothing, else null."""
    due = slots.groupBy("idx").agg(F.count("*").alias("n"))
    df = sources.join(due, "idx", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = F.col("source_size")
    blocks = F.greatest(F.ceil(size / F.lit(block_words)), F.lit(1)).cast("bigint")
    given = F.floor(F.col("n") / blocks) * size + F.least(size, F.col("n") % blocks * block_words)
    off = F.abs(given - F.col("target")) > F.greatest(F.lit(float(MISS[0])), F.col("target") * MISS[1])
    off = off | ((given == 0) & (F.col("target") > 0))
    exact = F.least(F.round("target").cast("bigint"), size * MAX_PASSES)
    return df.withColumn("exact", F.when(off, exact)).drop("n")


def exact_pieces(stream: DataFrame, block_words: int, total: int) -> DataFrame:
    """Rows of the sources laid out word by word: block k holds the words from k * block_words of the source's
    repeated documents."""
    lo = F.col("pass") * F.col("source_size") + F.col("at")
    df = (stream.filter(F.col("exact").isNotNull() & (F.col("size") > 0))
          .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(MAX_PASSES - 1).cast("bigint"))))
          .withColumn("lo", lo).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("exact")))
          .filter(F.col("hi") > F.col("lo")))
    df = df.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block_words),
                                                     F.floor((F.col("hi") - 1) / block_words))))
    df = (df.withColumn("begin", F.greatest("lo", F.col("block") * block_words))
          .withColumn("words", F.least("hi", (F.col("block") + 1) * block_words) - F.col("begin")))
    slot = F.floor((F.col("block") + 0.5) * -(-total // block_words) / F.ceil(F.col("exact") / block_words))
    return df.select("idx", "block", slot.alias("slot"), "pass", "doc_id", "at",
                     (F.col("begin") - F.col("lo")).alias("from_word"), "words")


def mix_sources(docs: DataFrame) -> Mix:
    """The mix of all documents.  A null text has 0 words and a null source is a source of its own (last);
    documents of 0 words are in the stream but in no block.  Repeated rows are laid out one by one; other
    columns are ignored; an empty table gives an empty mix.  A long document spans several blocks.
    Ties of the hash order go by id and size, so reruns agree."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("content"),
                        count_words(F.col("text")).alias("size")).checkpoint()
    sources = source_targets(sizes).checkpoint()        # one row per source
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block_words = min(BLOCK_WORDS, max(1, -(-total // LEAST_SLOTS)))
    slots = slot_schedule(spark, sources, total, block_words).checkpoint()
    sources = exact_sources(sources, slots, block_words).checkpoint()
    stream = document_stream(sizes, sources).checkpoint()
    first, after = F.floor(F.col("at") / block_words), F.col("at") + F.col("size")
    pieces = (stream.filter((F.col("size") > 0) & F.col("exact").isNull())
              .withColumn("block", F.explode(F.sequence(first, F.floor((after - 1) / block_words))))
              .withColumn("begin", F.greatest(F.col("at"), F.col("block") * block_words))
              .withColumn("words", F.least(after, (F.col("block") + 1) * block_words) - F.col("begin"))
              .select("idx", "block", "doc_id", "at", (F.col("begin") - F.col("at")).alias("from_word"), "words"))
    rows = slots.join(pieces, ["idx", "block"]).unionByName(exact_pieces(stream, block_words, total))
    return Mix(sources, stream, rows, block_words)


def _taken(docs: DataFrame) -> DataFrame:
    """The stream with ``taken``, the words the mix takes of each document, repeats counted."""
    mix = mix_sources(docs)
    taken = mix.rows.groupBy("idx", "at").agg(F.sum("words").alias("taken"))
    # documents of 0 words share the position of the next one
    words = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return mix.stream.join(taken, ["idx", "at"], "left").withColumn("taken", words)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    return _taken(docs).select("doc_id", "size", "source_size", "target", "taken")


def repeated_documents(docs: DataFrame) -> DataFrame:
    """``docs`` in the mix's proportions, in whole documents: each row as often as the mix takes it, rounded
    (half up) to 0 to MAX_PASSES copies.  All columns stay; documents of 0 words go."""
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    per = _taken(docs).groupBy(F.col("doc_id").alias("id"), F.col("content").alias("c")) \
        .agg(F.sum(copies).cast("int").alias("copies")).filter("copies > 0")
    rows = carried(docs).join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("c")))
    # rows that repeat an id and a text were added up, so one of them carries the copies
    return one_of_each(rows, "copies").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                  lambda x: x <> ''))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size,
              row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
s1 AS (SELECT *, idx % 3 + 1 AS weight, source_size * 3 AS most FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER w, 0))::DOUBLE
              / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
       FROM s1 WINDOW w AS (ORDER BY most / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT idx, source, source_size, least(most::DOUBLE,
              (max(level) OVER ()) * weight) AS target FROM s2),
c AS (SELECT sum(source_size)::BIGINT AS total,
             least(2048, greatest(1, (sum(source_size)::BIGINT + 65535) // 65536)) AS b FROM s3),
s4 AS (SELECT *, sum(target) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cum FROM s3),
s5 AS (SELECT *, CASE WHEN idx = (SELECT max(idx) FROM s3) THEN 2147483648
                 ELSE least(floor(cum / greatest(total, 1)::DOUBLE * 2147483648.0)::BIGINT, 2147483648) END AS hi FROM s4, c),
s6 AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY idx), 0) AS lo, (source_size + b - 1) // b AS nb FROM s5),
sl AS (SELECT (i % 2147483648) * 1327217885 % 2147483648 AS p
       FROM (SELECT unnest(generate_series(0, (total + b - 1) // b - 1)) AS i FROM c)),
cnt AS (SELECT idx, count(*) AS n FROM sl JOIN s6 ON p >= lo AND p < hi GROUP BY idx),
s7 AS (SELECT s6.*, least(coalesce(n, 0), 3 * nb) AS n FROM s6 LEFT JOIN cnt USING (idx)),
st AS (SELECT doc_id, size, s7.*, sum(size) OVER (PARTITION BY idx ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
              ROWS UNBOUNDED PRECEDING) - size AS pos
       FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE
       (n // nb) * size + greatest(0, least(pos + size, (n % nb) * b) - pos) END::BIGINT AS taken FROM st
"""
