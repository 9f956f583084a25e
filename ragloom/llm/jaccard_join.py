"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct word shingles.  Sets are ordered by one global
order, rare shingles first (rarity from a fixed-size count sketch over the whole
corpus, ties by hash); two sets that reach the similarity share a shingle within
their prefixes of ``n - ceil(t n) + 1``.

1. Exact copies collapse to one set; sets of equal size and prefix collapse to one
   group.
2. Groups that share a prefix shingle are candidates under size and position bounds.
3. Candidate groups are expanded to members and verified on whole sets.

A shingle or group with many members never emits all its pairs.  First every member
is verified against a few pivots of its bucket and the links found are closed to
components; then only pairs between different components are left to verify.  So no
link that would join two components is lost, while the pairs inside a large cluster
of near copies, which cannot change any component, are not enumerated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import carried, one_of_each, text_blocks
from .components import connected_components

SHINGLE, PERCENT = 4, 85
SKETCH_BITS = 16            # the count sketch has 2 ** SKETCH_BITS cells at any corpus size
PIVOT_ROUNDS = 2
PARITY_BITS = 256
CELLS = 1 << 20             # hash cells of ids that narrow a text scan (a bounded broadcast)

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_MEMO_WORDS = 200_000


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.memo = size, {}

    def __call__(self, texts: list) -> list[np.ndarray]:
        from xxhash import xxh64_intdigest

        memo, out = self.memo, []
        get = memo.__getitem__
        for t in texts:     # one text's words at a time
            words = t.encode("utf-8", "surrogatepass").lower().split() if t else []
            fresh = {w for w in words if w not in memo}
            if len(memo) + len(fresh) > _MEMO_WORDS:
                memo.clear()
                fresh = set(words)
            memo.update((w, xxh64_intdigest(w)) for w in fresh)
            out.append(np.unique(self._shingles(np.fromiter(map(get, words), np.uint64, len(words)))))
            for w in fresh:
                if len(w) > 64:
                    del memo[w]
        return out

    def _shingles(self, h: np.ndarray) -> np.ndarray:
        n = min(self.size, len(h))          # fewer words: the whole sequence is one shingle
        if not n:
            return h
        s = np.full(len(h) - n + 1, np.uint64(n))
        for i in range(n):
            s = (s ^ h[i:len(h) - n + 1 + i]) * _MIX[0]
            s ^= s >> np.uint64(29)
        s = (s ^ (s >> np.uint64(30))) * _MIX[1]
        s = (s ^ (s >> np.uint64(27))) * _MIX[2]
        return s ^ (s >> np.uint64(31))


def _signature(s: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest

    v = xxh3_128_intdigest(s.tobytes())
    return (v >> 64) - (1 << 63), (v & ((1 << 64) - 1)) - (1 << 63)


def _long(values) -> pa.Array:
    return pa.array(values, pa.int64())


def document_sets(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, np.ndarray]:
    """(one row per document: doc_id, content (hash of its text), n, s1, s2 (128-bit signature of its set);
    the count sketch)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "content", "n", "s1", "s2", "cell", "times"]

    def run(batches):
        shingle = Shingler(size)
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        ids = None
        for batch in batches:
            ids, content = batch.column(0), batch.column(1)
            for a, b, (texts,) in text_blocks(batch.column(2)):
                sets = shingle(texts)
                np.add(cells, np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64),
                                          minlength=len(cells)), out=cells)
                sig = [_signature(s) for s in sets]
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), content.slice(a, b - a), _long([len(s) for s in sets]),
                     _long([x for x, _ in sig]), _long([x for _, x in sig]), none, none], names=names)
        cell = np.flatnonzero(cells)
        if ids is not None and len(cell):
            none = pa.nulls(len(cell), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(cell), ids.type), none, none, none, none, _long(cell), _long(cells[cell])], names=names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(
        run, f"doc_id {id_type}, content long, n long, s1 long, s2 long, cell long, times long").checkpoint()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    # at most 2 ** SKETCH_BITS rows
    for r in rows.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("times").alias("times")).collect():
        sketch[r["cell"]] = r["times"]
    return rows.filter("cell IS NULL").drop("cell", "times"), sketch


def _needed(n: Column, percent: int) -> Column:
    """ceil(percent * n / 100) in integers."""
    return F.floor((n * percent + 99) / 100)


def prefix_sets(docs: DataFrame, sketch: np.ndarray, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per distinct non-empty set: sid, s1, s2, n, prefix (rare shingles first), parity (of the shingles
    in each of PARITY_BITS hash cells), least_doc."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch)       # 2 ** SKETCH_BITS numbers
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        shingle, cells = Shingler(size), shared.value
        for batch in batches:
            for a, b, (texts,) in text_blocks(batch.column(1)):
                sig, lens, prefix, parity = [], [], [], []
                for s in shingle(texts):
                    n = len(s)
                    keep = n - (percent * n + 99) // 100 + 1 if n else 0
                    often = cells[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    prefix.append(s[np.lexsort((s, often))[:keep]].view(np.int64))
                    odd = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
                    parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                    lens.append(n)
                    sig.append(_signature(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), _long(lens), _long([x for x, _ in sig]),
                     _long([x for _, x in sig]), pa.array(prefix, pa.list_(pa.int64())),
                     pa.array(parity, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "prefix", "parity"])

    rows = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n long, s1 long, s2 long, prefix array<long>, parity array<long>").filter("n > 0")
    return (rows.groupBy("s1", "s2", "n").agg(F.first("prefix").alias("prefix"), F.first("parity").alias("parity"),
                                              F.min("doc_id").alias("least_doc"))
            .withColumn("sid", F.monotonically_increasing_id()).checkpoint())


def whole_texts(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(sid, text) of the sets in ``wanted`` (sid, s1, s2, least_doc): a text that has the set.

    Texts travel, not sets: hashes do not compress, and a set is quickly made again."""
    def run(batches):
        shingle = Shingler(size)
        for batch in batches:
            for a, b, (texts,) in text_blocks(batch.column(3)):
                sig = [_signature(s) for s in shingle(texts)]
                own = zip(batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist(),
                          strict=True)
                at = pa.array([i for i, (x, y) in enumerate(zip(sig, own, strict=True)) if x == y], pa.int64())
                yield pa.RecordBatch.from_arrays(       # an id may have rows of other texts
                    [batch.column(0).slice(a, b - a).take(at), batch.column(3).slice(a, b - a).take(at)],
                    names=["sid", "text"])

    # only texts whose id falls in a wanted hash cell are shuffled
    near = _in_cells(docs.select("doc_id", "text"), "doc_id", wanted, "least_doc")
    ids = near.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("content"))
    found = (ids.join(wanted, F.col("id").eqNullSafe(F.col("least_doc")))
             .groupBy("least_doc", "sid", "s1", "s2", "content").agg(F.first("text").alias("text")))
    return found.select("sid", "s1", "s2", "text").mapInArrow(run, "sid long, text string").checkpoint()


def _in_cells(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` whose key falls in a hash cell of a wanted key: a filter with a broadcast of at most CELLS rows."""
    cells = wanted.select(F.pmod(F.xxhash64(wanted_key), F.lit(CELLS)).alias("cell")).distinct()
    return rows.withColumn("cell", F.pmod(F.xxhash64(key), F.lit(CELLS))) \
        .join(F.broadcast(cells), "cell", "left_semi").drop("cell")


def verified(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the similarity."""
    def run(batches):
        shingle = Shingler(size)
        for batch in batches:
            for a, b, (x, y) in text_blocks(batch.column(2), batch.column(3)):
                left, right = (batch.column(c).slice(a, b - a).to_pylist() for c in (0, 1))
                texts = dict(zip(left + right, x + y, strict=True))     # a set in several pairs of a range is made once
                sets = dict(zip(texts, shingle(list(texts.values())), strict=True))
                at = []
                for i, (s, t) in enumerate((sets[p], sets[q]) for p, q in zip(left, right, strict=True)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        at.append(a + i)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    left = texts.select(F.col("sid").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("sid").alias("b"), F.col("text").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long").distinct()


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _parity_fits(x: str, y: str, n: Column, m: Column, percent: int) -> Column:
    """Whether two sets can reach the similarity by their parities: each cell that differs holds a shingle that
    only one of them has, and at most (100 - percent) / (100 + percent) of the sizes may differ."""
    apart = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def _may_reach(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of rows (a, b, n, m, pos, pos2), one per shared prefix shingle, that can reach the similarity.

    The first shared shingle bounds what can follow it.  And behind the prefix that ends first nothing is common
    but that set's own remainder, so the shared prefix shingles have to make up the difference."""
    least = (F.col("n") + F.col("m")) * percent
    rest = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos2"))
    pairs = pairs.filter(_sizes_fit(F.col("n"), F.col("m"), percent))
    shared = pairs.groupBy("a", "b", "n", "m").agg(
        F.count("*").alias("c"), F.max(rest * (100 + percent) >= least).alias("near"))
    behind = F.greatest(_needed(F.col("n"), percent), _needed(F.col("m"), percent)) - 1
    return shared.filter(F.col("near") & ((F.col("c") + behind) * (100 + percent) >= least)).select("a", "b")


class _Texts:
    """Texts of sets by sid, fetched once each as candidates need them."""

    def __init__(self, docs: DataFrame, sets: DataFrame, size: int, percent: int):
        self.docs, self.sets = docs, sets.drop("prefix")
        self.size, self.percent, self.have = size, percent, None

    def verified(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        x = self.sets.select(F.col("sid").alias("a"), "n", F.col("parity").alias("x"))
        y = self.sets.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("parity").alias("y"))
        fits = _parity_fits("x", "y", F.col("n"), F.col("m"), self.percent)
        pairs = pairs.join(x, "a").join(y, "b").filter(fits).select("a", "b").checkpoint()
        need = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        missing = need if self.have is None else need.join(self.have.select("sid"), "sid", "left_anti")
        more = whole_texts(self.docs, self.sets.select("sid", "s1", "s2", "least_doc").join(missing, "sid"),
                           self.size)
        self.have = more if self.have is None else self.have.unionByName(more)
        return verified(pairs, _in_cells(self.have, "sid", need, "sid"), self.size, self.percent)


def shingle_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, content, n, s1, s2; sets: s1, s2, n, sid, least_doc, component (a sid), linked_doc)."""
    ensure_checkpoint_dir(docs.sparkSession)
    documents, sketch = document_sets(docs, size)
    sets = prefix_sets(docs, sketch, size, percent)
    # groups: equal size and prefix; only their heads are indexed
    keyed = sets.select("sid", "n", F.xxhash64("prefix").alias("p1"), F.hash("prefix").alias("p2"))
    groups = keyed.groupBy("n", "p1", "p2").agg(F.min("sid").alias("grp"))
    member = keyed.join(groups, ["n", "p1", "p2"]).select("sid", "n", "grp").checkpoint()
    index = sets.select("sid", "n", F.posexplode("prefix").alias("pos", "token"))
    # shingles that one set alone has make no candidate
    shared = index.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    # (an outer join: an anti join would be pushed below the explode and shuffle every prefix)
    behind = member.filter("sid <> grp").select("sid", F.lit(True).alias("behind"))
    index = (index.join(shared, "token").join(behind, "sid", "left").filter("behind IS NULL")
             .select("token", "pos", F.col("sid").alias("grp"), "n", F.col("sid").alias("component")).checkpoint())
    texts = _Texts(docs, sets, size, percent)

    # pivots: per bucket of similar sizes one member; the others are verified against it
    component, links = member.withColumn("component", F.col("sid")), None
    for turn in range(PIVOT_ROUNDS):
        band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)) + 0.5 * turn)
        row = index.withColumn("band", band)
        first = F.struct(F.xxhash64("grp", F.lit(turn)).alias("h"), "grp", "n", "component", "pos")
        pivot = row.groupBy("token", "band").agg(F.min(first).alias("p")).select(
            "token", "band", F.col("p.grp").alias("b"), F.col("p.n").alias("m"),
            F.col("p.component").alias("other"), F.col("p.pos").alias("pos2"))
        star = row.join(pivot, ["token", "band"]).filter(F.col("component") != F.col("other"))
        star = _may_reach(star.withColumnRenamed("grp", "a"), percent)
        if turn == 0:       # members of a group against its head
            star = star.unionByName(member.filter("sid <> grp").select(F.col("sid").alias("a"), F.col("grp").alias("b")))
        found = texts.verified(star)
        links = (found if links is None else links.unionByName(found)).checkpoint()
        component = _labelled(member, links)
        index = _mixed(index, component)

    # what is left: pairs of different components, within a group or through shared shingles
    apart = component.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .filter("lo <> hi").select("grp")
    known = component.join(sets.select("sid", "parity"), "sid")
    inner = _cross(known.join(apart, "grp", "left_semi"), "grp", percent).select("a", "b")
    row = index.select("token", "pos", "grp").join(known, "grp")
    outer = _may_reach(_cross(row, "token", percent), percent)
    links = links.unionByName(texts.verified(inner.unionByName(outer))).checkpoint()
    component = _labelled(member, links)
    least = sets.select("sid", "least_doc").join(component.select("sid", "component"), "sid") \
        .groupBy("component").agg(F.min("least_doc").alias("linked_doc"))
    labelled = sets.drop("prefix", "parity").join(component.select("sid", "component"), "sid").join(least, "component")
    return documents, labelled


def _mixed(index: DataFrame, component: DataFrame) -> DataFrame:
    """``index`` under the heads' new components, without the shingles that lie in one component alone.

    A group of several components is in the index by its head only, so its shingles all stay."""
    label = component.groupBy("grp").agg(F.min(F.when(F.col("sid") == F.col("grp"), F.col("component"))).alias("component"),
                                         F.min("component").alias("lo"), F.max("component").alias("hi"))
    row = index.drop("component").join(label, "grp")
    mixed = row.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("token")
    return row.drop("lo", "hi").join(mixed, "token", "left_semi") \
        .select("token", "pos", "grp", "n", "component").checkpoint()


def _labelled(member: DataFrame, links: DataFrame) -> DataFrame:
    comp = connected_components(links)
    return member.join(comp.withColumnRenamed("node", "sid").withColumnRenamed("component", "c"), "sid", "left") \
        .select("sid", "grp", "n", F.coalesce("c", "sid").alias("component")).checkpoint()


def _cross(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """Rows (a, b, n, m, pos, pos2) of members of different components that share ``key`` and can reach the
    similarity by size and parity.

    Components meet first, by the range of their sizes and, of single members, their parity; only what meets is
    expanded, the smaller component before the larger, so pairs inside a component are never formed."""
    span = rows.groupBy(key, "component").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"),
                                              F.first("parity").alias("x"))
    other = span.select(key, F.col("component").alias("other"), F.col("k").alias("k2"), F.col("lo").alias("lo2"),
                        F.col("hi").alias("hi2"), F.col("x").alias("y"))
    alone = (F.col("k") == 1) & (F.col("k2") == 1)
    meet = (span.join(other, key).filter(
        (F.struct("k", "component") > F.struct("k2", "other"))
        & (F.col("hi") * 100 >= F.col("lo2") * percent) & (F.col("hi2") * 100 >= F.col("lo") * percent)
        & (~alone | _parity_fits("x", "y", F.col("hi"), F.col("hi2"), percent))).select(key, "component", "other"))
    pos = F.col("pos") if "pos" in rows.columns else F.lit(0)
    a = rows.select(key, "component", F.col("sid").alias("a"), "n", pos.alias("pos"), F.col("parity").alias("x"))
    b = rows.select(key, F.col("component").alias("other"), F.col("sid").alias("b"), F.col("n").alias("m"),
                    pos.alias("pos2"), F.col("parity").alias("y"))
    fits = _sizes_fit(F.col("n"), F.col("m"), percent) & _parity_fits("x", "y", F.col("n"), F.col("m"), percent)
    pairs = meet.join(b, [key, "other"]).join(a, [key, "component"]).filter(fits)
    # which component is the larger differs from key to key; a pair is always named by its smaller sid first
    swap = F.col("a") > F.col("b")
    return pairs.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (
        ("a", "b"), ("b", "a"), ("n", "m"), ("m", "n"), ("pos", "pos2"), ("pos2", "pos"))))


def _with_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, content, n_shingles, component_id, set_of (the component's number; null: no shingles)."""
    documents, sets = shingle_components(docs, size, percent)
    known = sets.select("s1", "s2", F.col("n").alias("set_n"), "component", "linked_doc")
    out = documents.join(known, (documents["s1"] == known["s1"]) & (documents["s2"] == known["s2"])
                         & (documents["n"] == known["set_n"]), "left")
    return out.select("doc_id", "content", documents["n"].alias("n_shingles"),
                      F.coalesce("linked_doc", "doc_id").alias("component_id"), F.col("component").alias("set_of"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row.

    Null, empty and wordless texts have no shingle and are linked with nothing.  Repeated rows and
    exact copies share a set and so a component; rows that repeat an id with another text are
    separate documents.  Other columns are ignored; an empty table gives an empty result; texts are
    shingled whole."""
    return _with_components(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def one_per_component(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: that of the smallest id (null
    last), then text hash.  Rows without a shingle stay.  Rows that repeat an id and a text count as one document."""
    rows = _with_components(docs, size, percent)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    best = rows.filter("set_of IS NOT NULL").groupBy("set_of").agg(F.min(order).alias("b")) \
        .select(F.col("b.doc_id").alias("id"), F.col("b.content").alias("c"))
    best = best.unionByName(rows.filter("set_of IS NULL").select(
        F.col("doc_id").alias("id"), F.col("content").alias("c")).distinct())
    kept = carried(docs).join(best, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("c")), "left_semi")
    return one_of_each(kept).select("row.*")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(generate_series(1, len(w) - 3),
           lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh)::BIGINT AS n, unnest(sh) AS x FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c AS component_id
FROM s JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) r ON r.u = s.doc_id
"""
