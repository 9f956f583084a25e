"""Quality rules: repetition inside a document and line frequency across documents.

Native Spark only.  The base counts are array expressions inside the document's row.
The cross-document rule hashes normalised lines (lower case, white space collapsed
and trimmed), counts per host the distinct documents that hold a line, removes the
lines above the host's limit, and rejects documents that keep too little of their
text.  Exact copies of a document count as one, so a copied document is no evidence
that its lines are boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
LINE_MIN_DOCS = 50          # a line is never removed below this many documents of the host ...
LINE_HOST_PERCENT = 2       # ... nor below this share of them
KEEP_PERCENT = 20           # a document that keeps less of its distinct lines' characters is rejected
SALTS = 16

_SPACE = r"[\x20\x09-\x0D]+"
_INLINE_SPACE = r"[\x20\x09\x0B-\x0D]+"


def _pairs(hashes: str, gap: int) -> Column:
    """Hash of each element with the one ``gap`` behind it."""
    n = F.greatest(F.size(hashes) - gap, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.  Null text: empty."""
    df = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__w", F.array_remove(F.split("__t", _SPACE), ""))
    df = df.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # hashes of runs of 1, 2, 4 and 8 words by doubling
    df = df.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    for gap in (1, 2, 4):
        df = df.withColumn("__h", _pairs("__h", gap))
    repeated = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__h", F.when(repeated, F.col("__h")).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__s", F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    # sorted by hash, a window is found twice when a neighbour has its hash
    n = F.size("__s")
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("__s.h", 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice("__s.h", F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("bigint")))
    df = df.withColumn("__n", F.arrays_zip(F.col("__s").alias("s"), before.alias("b"), after.alias("a")))
    df = df.withColumn("__p", F.array_sort(F.transform(
        F.filter("__n", lambda x: F.coalesce(x["s"]["h"] == x["b"], F.lit(False))
                 | F.coalesce(x["s"]["h"] == x["a"], F.lit(False))), lambda x: x["s"]["i"])))
    step = F.zip_with(F.slice("__p", F.lit(2), F.greatest(F.size("__p") - 1, F.lit(0))),
                      F.slice("__p", 1, F.greatest(F.size("__p") - 1, F.lit(0))),
                      lambda nxt, cur: F.least(nxt - cur, F.lit(WINDOW_WORDS)).cast("bigint"))
    covered = F.when(F.size("__p") > 0, F.aggregate(step, F.lit(WINDOW_WORDS).cast("bigint"), lambda a, x: a + x)) \
        .otherwise(F.lit(0).cast("bigint"))
    df = (df.withColumn("n_words", F.size("__w").cast("bigint"))
          .withColumn("word_chars", F.length(F.array_join("__w", "")).cast("bigint"))
          .withColumn("n_symbols", F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("bigint"))
          .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
          .withColumn("n_repeat_words", covered))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                       | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    return df.drop("__t", "__w", "__lines", "__h", "__s", "__n", "__p")


def normal_lines(text: Column) -> Column:
    """Distinct (hash, characters) of a text's normalised lines that hold a word."""
    clean = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _INLINE_SPACE, " "))
    rows = F.transform(F.split(clean, "\n"), lambda x: F.trim(x))
    return F.array_distinct(F.transform(
        F.array_remove(rows, ""), lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("chars"))))


def quality_rules(docs: DataFrame, min_docs: int = LINE_MIN_DOCS, host_percent: int = LINE_HOST_PERCENT,
                  keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """doc_id, the base counts, base_failed, line_chars, removed_chars and kept of every row.

    Null and empty texts have no word and fail the base; a null source is a host of its own;
    repeated rows (also of one id) are judged one by one but count once as evidence; other columns
    are ignored; an empty table gives an empty result.  A collision of 64-bit line hashes could only
    add up two lines' counts."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = base_rules(docs.select("doc_id", "source", "text"))
    rows = (rows.withColumn("lines", normal_lines(F.col("text")))
            .withColumn("host", F.xxhash64("source")).withColumn("content", F.xxhash64("text"))
            .drop("text", "source").checkpoint())       # one pass over the text; counts and line hashes stay
    held = (rows.select("host", "content", F.explode("lines").alias("l"))
            .select("host", "content", "l.line", "l.chars").distinct())
    sizes = rows.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    often = (held.groupBy("host", "line").agg(F.count("*").alias("in_docs"))
             .filter(F.col("in_docs") > min_docs)       # leaves few lines, so the hot host's are few too
             .join(sizes, "host").filter(F.col("in_docs") * 100 > F.col("docs") * host_percent)
             .select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    # a common line is a hot key: its documents are spread over SALTS keys
    removed = (held.withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int"))
               .join(often, ["host", "line", "salt"])
               .groupBy("host", "content").agg(F.sum("chars").alias("removed_chars")))
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["chars"])
    out = rows.withColumn("line_chars", total).join(removed, ["host", "content"], "left")
    left = F.col("line_chars") - F.coalesce("removed_chars", F.lit(0))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (left * 100 >= F.col("line_chars") * keep_percent)).alias("kept"),
        "line_chars", F.coalesce("removed_chars", F.lit(0)).cast("bigint").alias("removed_chars"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
win AS (SELECT rid, i, w[i:i + 7] AS k FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i
        FROM w WHERE len(w) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nx - i, 8))) AS n_repeat_words
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM dup) GROUP BY rid),
base AS (SELECT rid, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                n_symbols::BIGINT AS n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
                coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
nl AS (SELECT DISTINCT rid, source, t, trim(x, ' ') AS line FROM (SELECT rid, source, t, unnest(string_split(
       lower(regexp_replace(t, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), chr(10))) AS x FROM d) WHERE trim(x, ' ') <> ''),
hd AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
oft AS (SELECT source, line, count(DISTINCT t) AS n FROM nl GROUP BY source, line HAVING count(DISTINCT t) > 50),
hv AS (SELECT oft.source, line FROM oft JOIN hd ON oft.source IS NOT DISTINCT FROM hd.source WHERE n * 100 > docs * 2),
ch AS (SELECT rid, sum(length(nl.line))::BIGINT AS line_chars,
              coalesce(sum(length(hv.line)), 0)::BIGINT AS removed_chars
       FROM nl LEFT JOIN hv ON nl.line = hv.line AND nl.source IS NOT DISTINCT FROM hv.source GROUP BY rid),
j AS (SELECT doc_id, base.*, coalesce(line_chars, 0)::BIGINT AS line_chars,
             coalesce(removed_chars, 0)::BIGINT AS removed_chars,
             n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed
      FROM d JOIN base USING (rid) LEFT JOIN ch USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (line_chars - removed_chars) * 100 >= line_chars * 20 AS kept,
       line_chars, removed_chars FROM j
"""
