"""Line de-duplication by a segment-partition edit join.

Native Spark only.  Lines are compared in lower case with white space collapsed and
trimmed.  Equal lines keep their first occurrence; lines of ``MIN_CHARS``
take part, and with ``short`` every line that holds a word.  Different lines of ``MIN_CHARS`` and more are near when their
edits are at most those of the shorter one: ``EDITS``, and one more for every ``STEP``
characters up to the ``MOST`` that the edit band holds.  They are found by segments: a
line of e edits is split into e + 1 disjoint segments, and a line within reach holds one
of them unchanged.  The first segments are placed from the line's start and the last from
its end, all by the lower end of the line's length class, so a line needs one key for its
outer segments, three for the inner ones (shifted by one or not), and those of the next
shorter class too when it is within reach of it.
Candidates that share a key are filtered by a word parity signature and verified by a
bit-parallel automaton over the 2 * e + 1 diagonals of the edit band.

A line goes when a line that occurs earlier is near it.  One such witness is enough, so a bucket of many similar lines is first settled against its
earliest line; only lines that are left meet the other lines of their buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path
from .common import carried

EDITS = 1
MIN_CHARS = 24
STEP = 64
MOST = 3
CLASS = 16              # lengths of one class: segments are cut by its lowest
LONG_LINE = 512         # lines up to this length are compared by the built-in distance, whose time grows with the square
SALTS = 16
CELLS = 1 << 20         # hash cells of document ids that narrow a text scan (a bounded broadcast)

_INLINE_SPACE = r"[\x20\x09\x0B-\x0D]+"
_UNEVEN_SPACE = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+"


def normal_line(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, _INLINE_SPACE, " ")))


def _clean(text: Column) -> Column:
    """The text in lower case, every run of inline space one space (single spaces are not rewritten)."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN_SPACE, " "))


def _identity(x: Column) -> tuple[Column, Column]:
    return F.xxhash64(x), F.xxhash64(F.lit(1), x)


def takes_part(line: Column, short: bool) -> Column:
    """Lines that are compared: those of MIN_CHARS, with ``short`` also shorter ones that hold a word."""
    long = F.length(line) >= MIN_CHARS
    return long | line.rlike(r"[\p{L}\p{N}]") if short else long


def allowed(length: str, edits: int | None) -> str:
    """SQL int: edits that a line of ``length`` characters may differ by; ``edits`` when given."""
    return str(edits) if edits is not None else f"cast(least({MOST}, {EDITS} + ({length}) div {STEP}) as int)"


def class_of(length: str) -> str:
    """SQL int: the lowest length of the class that ``length`` is in."""
    return f"if(({length}) between {MIN_CHARS} and {MIN_CHARS // CLASS * CLASS + CLASS - 1}, {MIN_CHARS}, ({length}) div {CLASS} * {CLASS})"


def segment_parts(line: str, length: str, base: str, edits: str) -> tuple[list[str], list[str]]:
    """SQL keys (0: none) of the line's ``edits`` + 1 segments in the class of length ``base``, and of what stands
    beside them.

    If a line within ``edits`` of this one leaves some segments alone, one of them, i, has at most i edits before it
    and ``edits`` - i behind it; so it is moved by at most i from the start, ``edits`` - i from the end.  The two
    lowest bits of a key hold ``edits``."""
    size = f"(({base}) div ({edits} + 1))"

    def key(slot: int, shift: int) -> str:      # slots from the start: 0, 1; from the end: 2, 3
        at = f"{slot} * {size}" if slot < 2 else f"{length} - {slot - 1} * {size}"
        text = f"substring({line}, cast({at} + {1 + shift} as int), cast({size} as int))"
        found = f"((xxhash64(cast({base} as int), {slot}, {text}) & -4L) | cast({edits} as bigint))"
        return f"if({edits} >= {(1, 2, 1, 3)[slot]}, {found}, 0L)"

    return [key(slot, 0) for slot in range(4)], [key(slot, shift) for slot in (1, 3) for shift in (-1, 1)]


def segment_keys(line: str, length: str, edits: int) -> str:
    """SQL array of keys: the line's own EDITS + 1 segments, then what probes lines of its class and, within reach,
    of the class below."""
    return _two_classes(line, length, str(edits), f"{length} - {edits}", str(edits), "true")


def _two_classes(line: str, length: str, edits: str, least: str, edits_below: str, least_takes_part: str) -> str:
    own, beside = segment_parts(line, length, class_of(length), edits)
    below = class_of(least)
    low = [f"if({below} <> {class_of(length)} and ({least}) >= 0 and {least_takes_part}, {k}, 0L)"
           for part in segment_parts(line, length, below, edits_below) for k in part]
    return f"array_remove(array({', '.join(own + beside + low)}), 0L)"


def line_keys(line: str, length: str, edits: int | None) -> str:
    """As ``segment_keys``, each line split by the edits its own length allows, and for the class below by those that
    its lengths allow (bounds of allowed edits are bounds of classes); short lines have no key."""
    below = allowed(f"({length} - {MOST})", edits)
    least = f"({length} - {below})"
    keys = _two_classes(line, length, allowed(length, edits), least, below, f"{least} >= {MIN_CHARS}")
    return f"if({length} >= {MIN_CHARS}, {keys}, cast(array() as array<bigint>))"


def within_edits(a: str, b: str, edits: int) -> str:
    """SQL boolean: the edit distance of strings ``a`` and ``b`` (array columns of characters) is at most ``edits``.

    Lane k of the state, 8 or 16 bits each, holds the diagonals reachable with at most k errors.  A step reads one
    character of ``a``: matching diagonals stay, an error lifts a diagonal to the next lane in place (substitution)
    or one lower (deletion), and inside a step one higher (insertion)."""
    lane = 8 if edits <= 3 else 16
    if edits > 3:
        raise ValueError("the state holds up to 3 edits")
    width = 2 * edits + 1
    ones = sum(1 << (lane * k) for k in range(edits + 1))
    lanes = ((1 << width) - 1) * ones
    first = sum(((1 << (k + 1)) - 1) << edits << (lane * k) for k in range(edits + 1))
    mask = " + ".join(f"if(x = get({b}, i + {d}), {1 << (d + edits)}L, 0L)" for d in range(-edits, edits + 1))
    step = f"((r & (m * {ones}L)) | shiftleft(r, {lane}) | shiftleft(shiftright(r, 1) & {lanes}L, {lane})) & {lanes}L"
    for _ in range(edits):
        step = f"transform(array({step}), s -> (s | shiftleft(s, {lane + 1})) & {lanes}L)[0]"
    run = f"aggregate(transform({a}, (x, i) -> {mask}), {first}L, (r, m) -> {step})"
    goal = f"shiftright({run}, cast({edits * lane} + size({b}) - size({a}) + {edits} as int)) & 1L"
    return f"abs(size({a}) - size({b})) <= {edits} and ({goal}) = 1L"


def near_enough(a: str, b: str, edits: int | None) -> str:
    """SQL boolean: the edit distance of string columns ``a`` and ``b`` is at most what the shorter one allows.  Of
    those over LONG_LINE, columns ``a``_chars and ``b``_chars hold the characters."""
    n, m = f"length({a})", f"length({b})"
    most = allowed(f"least({n}, {m})", edits)
    when = " ".join(f"when {e} then {within_edits(f'{a}_chars', f'{b}_chars', e)}"
                    for e in (range(EDITS, MOST + 1) if edits is None else [edits]))
    return (f"case when abs({n} - {m}) > {most} then false when greatest({n}, {m}) <= {LONG_LINE} "
            f"then levenshtein({a}, {b}, {most}) between 0 and {most} else case {most} {when} end end")


def characters(line: Column) -> Column:
    return F.array_remove(F.split(line, ""), "")


def _place(doc_id: Column) -> Column:
    """Ids in order, null last."""
    return F.coalesce(doc_id.cast("bigint"), F.lit((1 << 63) - 1))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint, read by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def document_lines(docs: DataFrame, edits: int | None, short: bool) -> DataFrame:
    """doc_id, content (hash of the text), pos, chars, h1, h2, parity, own edits and keys of every line that takes
    part."""
    df = docs.select("doc_id", F.xxhash64("text").alias("content"), F.posexplode(F.split(_clean(F.col("text")), "\n")).alias("pos", "line"))
    df = df.withColumn("line", F.trim("line")).filter(takes_part(F.col("line"), short)).withColumn("n", F.length("line"))
    # each edit changes at most three words, so at most three bits
    parity = "aggregate(split(line, ' '), 0L, (a, w) -> a ^ shiftleft(1L, cast(pmod(xxhash64(w), 64) as int)))"
    h1, h2 = _identity(F.col("line"))
    return df.select("doc_id", "content", "pos", F.col("n").alias("chars"), h1.alias("h1"), h2.alias("h2"),
                     F.expr(parity).alias("parity"), F.expr(allowed("n", edits)).alias("own"),
                     F.expr(line_keys("line", "n", edits)).alias("keys"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """h1, h2, first occurrence (doc, content, pos), copies, chars, parity, own edits and keys of every distinct line."""
    first = F.struct(_place(F.col("doc_id")).alias("doc"), "content", "pos")
    return (lines.groupBy("h1", "h2").agg(F.min(first).alias("first"), F.count("*").alias("copies"),
                                          *(F.first(c).alias(c) for c in ("chars", "parity", "own", "keys")))
            .select("h1", "h2", "first.*", "copies", "chars", "parity", "own", "keys"))


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, line, and of about LONG_LINE or more its chars) of the lines whose first occurrences are in ``wanted``.

    Only texts whose id falls in a wanted hash cell are shuffled."""
    cells = wanted.select(F.pmod(F.xxhash64("doc"), F.lit(CELLS)).alias("cell")).distinct()     # at most CELLS rows
    near = docs.select(_place(F.col("doc_id")).alias("id"), "text").withColumn(
        "cell", F.pmod(F.xxhash64("id"), F.lit(CELLS))).join(F.broadcast(cells), "cell", "left_semi")
    rows = near.withColumn("c", F.xxhash64("text")).join(
        wanted, (F.col("id") == F.col("doc")) & (F.col("c") == F.col("content")))
    line = normal_line(F.get(F.split("text", "\n"), F.col("pos")))
    return rows.select("h1", "h2", line.alias("line")).dropDuplicates(["h1", "h2"]).select(
        "h1", "line", F.when(F.length("line") > LONG_LINE - MOST, characters(F.col("line"))).alias("chars"))


def near_lines(docs: DataFrame, distinct: DataFrame, edits: int | None) -> DataFrame:
    """h1, h2 of the lines with an earlier line within ``edits`` edits, or those that the lengths allow."""
    # a line has many keys and most meet nothing, so keys travel alone
    rows = distinct.select("h1", "own", F.posexplode("keys").alias("k", "key")) \
        .select("key", "h1", (F.col("k") > F.col("own")).alias("probe"))
    places = distinct.select("h1", "h2", "doc", "content", "pos")

    def settle(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct().checkpoint()
        need = pairs.select(F.col("late").alias("h1")).unionByName(pairs.select(F.col("early").alias("h1"))).distinct()
        texts = line_texts(docs, places.join(need, "h1")).checkpoint()
        a = texts.select(F.col("h1").alias("late"), F.col("line").alias("x"), F.col("chars").alias("x_chars"))
        b = texts.select(F.col("h1").alias("early"), F.col("line").alias("y"), F.col("chars").alias("y_chars"))
        return (pairs.join(a, "late").join(b, "early").filter(F.expr(near_enough("x", "y", edits)))
                .select(F.col("late").alias("h1")).distinct().checkpoint())

    def pairs_of(met: DataFrame) -> DataFrame:
        """(late, early) of rows with a line (h1, parity, doc, pos, chars) and another (h, p, d, q, n), if within reach."""
        flips = F.bit_count(F.col("parity").bitwiseXOR(F.col("p")))
        later = F.struct("doc", "pos", "h1") > F.struct("d", "q", "h")
        most = F.col("key").bitwiseAND(F.lit(3))
        return met.filter((F.col("h1") != F.col("h")) & (F.abs(F.col("chars") - F.col("n")) <= most) & (flips <= 3 * most)).select(
            F.when(later, F.col("h1")).otherwise(F.col("h")).alias("late"),
            F.when(later, F.col("h")).otherwise(F.col("h1")).alias("early"))

    def as_other(index: DataFrame) -> DataFrame:
        return index.select("key", F.col("h1").alias("h"), F.col("parity").alias("p"), F.col("doc").alias("d"),
                            F.col("pos").alias("q"), F.col("chars").alias("n"))

    # rows that meet an index line of another line, each with its bucket's earliest
    index, bucket = F.when(~F.col("probe"), F.struct("doc", "pos", "h1", "parity", "chars")), Window.partitionBy("key")
    shared = (rows.withColumn("c", F.count(F.when(~F.col("probe"), 1)).over(bucket)).withColumn("t", F.count("*").over(bucket))
              .filter((F.col("c") > 0) & (F.col("t") > 1)).select("key", "h1", "probe").checkpoint())
    shared = shared.join(distinct.select("h1", "parity", "doc", "pos", "chars"), "h1")
    met = (shared.withColumn("m", F.min(index).over(bucket)).withColumn("c", F.count(index).over(bucket))
           .filter((F.col("m.h1") != F.col("h1")) | (F.col("c") > 1))
           .select("key", "h1", "parity", "doc", "pos", "chars", "probe", F.col("m.h1").alias("h"), F.col("m.parity").alias("p"),
                   F.col("m.doc").alias("d"), F.col("m.pos").alias("q"), F.col("m.chars").alias("n")).checkpoint())
    settled = settle(pairs_of(met))

    heads = met.select("key", F.col("h").alias("h1"), F.col("p").alias("parity"), F.col("d").alias("doc"),
                       F.col("q").alias("pos"), F.col("n").alias("chars"), F.lit(False).alias("probe")).distinct()
    busy = met.filter((F.col("h1") != F.col("h")) | F.col("probe")).select(*heads.columns).unionByName(heads)
    open_rows = busy.join(settled, "h1", "left_anti")
    index = busy.filter(~F.col("probe"))
    # the later line of a pair is the one in question, whichever side probes
    late = pairs_of(open_rows.join(as_other(index), "key"))
    probes = busy.filter("probe").join(settled, "h1", "left_semi")
    late = late.unionByName(pairs_of(probes.join(as_other(index.join(settled, "h1", "left_anti")), "key")))
    rest = settle(late.join(settled.withColumnRenamed("h1", "late"), "late", "left_anti"))
    return distinct.select("h1", "h2").join(settled.unionByName(rest), "h1", "left_semi")


def removed_lines(docs: DataFrame, edits: int | None = None, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """(every row's doc_id, content and n_lines; removed occurrences: doc_id, content, pos, chars, near)."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("content"),
                       F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    lines = _written(document_lines(docs, edits, short), "document-lines")
    distinct = _written(distinct_lines(lines), "distinct-lines")
    near = near_lines(docs, distinct, edits).withColumn("near", F.lit(True)).checkpoint()
    hit = (distinct.select("h1", "h2", "copies", F.struct("doc", "content", "pos").alias("first"))
           .join(near, ["h1", "h2"], "left").filter((F.col("copies") > 1) | F.col("near"))
           .select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"),
                   F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    seen = lines.select("doc_id", "content", "pos", "chars", "h1", "h2")
    here = F.struct(_place(F.col("doc_id")).alias("doc"), "content", "pos")
    # a common line is a hot key: its occurrences are spread over SALTS keys
    gone = (seen.withColumn("salt", F.pmod(F.xxhash64("doc_id", "content"), F.lit(SALTS)).cast("int"))
            .join(hit, ["h1", "h2", "salt"]).filter(F.col("near") | ~here.eqNullSafe(F.col("first"))))
    return rows, gone.select("doc_id", "content", "pos", "chars", "near").distinct()


def _per_document(gone: DataFrame) -> DataFrame:
    near = F.col("near").cast("bigint")
    return gone.groupBy(F.col("doc_id").alias("id"), F.col("content").alias("c")).agg(
        F.sum(1 - near).alias("exact"), F.sum(near).alias("near"), F.sum("chars").alias("chars"),
        F.sort_array(F.collect_list("pos")).alias("at"))      # at most the lines of one text


def line_dedup(docs: DataFrame, edits: int | None = None, short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near (removed lines) and removed_chars (normalised) of every row.

    Null and empty texts have one empty line, which takes no part.  Rows that repeat an id and a text are
    one document: their lines are not removed for each other.  The order of occurrences is by id (null
    last), then text hash, then place.  Other columns are ignored; an empty table gives an empty result;
    lines are compared whole, whatever their length."""
    rows, gone = removed_lines(docs, edits, short)
    per = _per_document(gone)
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("id"))
                    & F.col("content").eqNullSafe(F.col("c")), "left")
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"),
                      F.coalesce("exact", zero).alias("n_exact"), F.coalesce("near", zero).alias("n_near"),
                      F.coalesce("chars", zero).cast("bigint").alias("removed_chars"))


def dedup_lines(docs: DataFrame, edits: int | None = None, text: str = "text", short: bool = False) -> DataFrame:
    """``docs`` with the removed lines cut out of the text (a null text stays null); rows left without a
    word that had one go.  All columns stay."""
    _, gone = removed_lines(docs.select("doc_id", F.col(f"`{text}`").alias("text")), edits, short)
    per = _per_document(gone).select("id", "c", "at")
    body = F.col(f"row.`{text}`")
    df = carried(docs, text).join(per, F.col("doc_id").eqNullSafe(F.col("id"))
                                  & F.col("content").eqNullSafe(F.col("c")), "left")
    kept = F.array_join(F.transform(F.filter(F.transform(
        F.split(body, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda s: ~F.array_contains("at", s["i"])), lambda s: s["x"]), "\n")
    df = df.withColumn("new", F.when(F.col("at").isNull(), body).otherwise(kept)).filter(
        F.col("at").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    return df.select(*(F.col("new").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))
