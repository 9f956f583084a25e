"""Line de-duplication, Jaccard join, top-k, mixing and line rules against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import line_dedup as LD
from ragloom.llm import line_rules, mixing, topk
from ragloom.llm.components import connected_components
from ragloom.llm.jaccard_join import jaccard_components, one_per_component

from . import brute
from .conftest import SCHEMA, rows_of


def mutate(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, kind = rng.randrange(len(s) + 1), rng.random()
        if kind < 0.33 and s:
            s.pop(min(i, len(s) - 1))
        elif kind < 0.66:
            s.insert(i, rng.choice("abcé "))
        elif s:
            s[min(i, len(s) - 1)] = rng.choice("abé日")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_band_and_segment_keys(spark, edits):
    rng = random.Random(3)
    pairs = []
    for _ in range(1200):
        a = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 30)))
        pairs.append((a, mutate(rng, a, rng.randint(0, 5))))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(LD.characters(F.col("a")).alias("x"), LD.characters(F.col("b")).alias("y")) \
        .select(F.expr(LD.within_edits("x", "y", edits)))
    assert [r[0] for r in got.collect()] == [brute.distance_within(a, b, edits) for a, b in pairs]
    near = [(a, b) for a, b in pairs if min(len(a), len(b)) > edits + 2 and a != b and brute.distance_within(a, b, edits)]
    df = spark.createDataFrame(near, "a string, b string").selectExpr("*", "length(a) m", "length(b) n")
    df = df.selectExpr(f"{LD.segment_keys('a', 'm', edits)} p", f"{LD.segment_keys('b', 'n', edits)} q")
    meet = f"size(array_intersect({{0}}, slice({{1}}, 1, {edits + 1})))"
    assert df.selectExpr(f"{meet.format('p', 'q')} + {meet.format('q', 'p')} as n").filter("n = 0").count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup(spark, edits):
    rng = random.Random(8)
    base = ["".join(rng.choice("abc de") for _ in range(rng.randint(20, 60))) for _ in range(12)]
    rows = [(i, "\n".join(mutate(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2])) for _ in range(rng.randint(0, 6))))
            for i in range(60)]
    rows += [(None, base[0] + "\n" + base[1]), (61, None), (62, ""), rows[5], (63, "  " + base[2].upper() + "\t ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("x")).repartition(4)
    gone = brute.line_removals(rows, edits)
    want = sorted(((i, len((t or "").split("\n")), len(gone[i, t][0]), len(gone[i, t][1])) for i, t in rows), key=repr)
    assert rows_of(LD.line_dedup(df, edits), "doc_id", "n_lines", "n_exact", "n_near") == want
    left = LD.dedup_lines(df, edits)
    assert left.columns == df.columns
    kept = []
    for i, t in rows:
        out = gone[i, t][0] | gone[i, t][1]
        text = t if not out else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in out)
        if not out or text.strip():
            kept.append((i, text))
    assert rows_of(left, "doc_id", "text") == sorted(kept, key=repr)


def test_line_dedup_edges(docs, no_docs, rows):
    assert LD.line_dedup(docs).count() == len(rows)
    assert LD.line_dedup(no_docs).count() == 0
    assert LD.dedup_lines(no_docs).columns == no_docs.columns


def test_many_similar_lines_settle_on_the_first(spark):
    """A large bucket of lines within one edit of the earliest: all but the first go."""
    rows = [(i, f"the same template line with one place that changes: {chr(97 + i % 26)} end {'' if i < 26 else '.'}")
            for i in range(52)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute.line_removals(rows, 1)
    got = LD.line_dedup(df).agg(F.sum("n_near")).first()[0]
    assert got == sum(len(x[1]) for x in gone.values()) >= 25


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randint(1, 50)) for _ in range(60)] + [(7, 7), (300, 200)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert {got[i] for i in range(41)} == {0}
    assert {got[max(e)] for e in edges[40:100]} == {100} and got[300] == got[200] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, docs, rows, k, percent):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(400)]
    extra = []
    for c in range(4):      # clusters of near copies: links chain, not every pair is linked
        w = [rng.choice(words) for _ in range(rng.choice([3, 25, 60, 120]))]
        for i in range(14):
            extra.append((2000 + 100 * c + i, " ".join(w)))
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(words)
    extra += [(2500, "one two"), (2501, "One  TWO"), (2502, "one"), (2503, "é É"), (2504, "É é")]
    every = [(r[0], r[1]) for r in rows] + extra
    df = docs.select("doc_id", "text", "score").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string").withColumn("score", F.lit("y")))
    order = sorted(range(len(every)), key=lambda i: (every[i][0] is None, every[i][0] or 0))
    head, sets = brute.components([every[i][1] for i in order], k, percent)
    want = sorted(((every[i][0], len(sets[p]), every[order[head[p]]][0]) for p, i in enumerate(order)), key=repr)
    assert rows_of(jaccard_components(df, k, percent), "doc_id", "n_shingles", "component_id") == want
    kept = one_per_component(df, k, percent)
    stay = sorted({every[i] for p, i in enumerate(order) if head[p] == p}, key=repr)
    assert kept.columns == df.columns and rows_of(kept, "doc_id", "text") == stay


def test_jaccard_edges(no_docs):
    assert jaccard_components(no_docs).count() == 0
    assert one_per_component(no_docs).columns == no_docs.columns


def brute_top(rows, k, every):
    ok = [(i, [np.floor(256.0 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        own = min((v for i, v in ok if i == q), key=lambda v: np.array(v, "<i8").tobytes())
        scored = sorted((-int(sum(a * b for a, b in zip(own, v, strict=False))), i) for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "pivots"), [(3, 16), (700, 16), (700, 2)])
def test_exact_top_k(spark, monkeypatch, n, pivots):
    monkeypatch.setattr(topk, "FIT_VECTORS", 128)
    monkeypatch.setattr(topk, "PIVOTS", pivots)
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "CHUNK", 8)
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=6) + 3 * (i % 3)]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0, None]), (n + 2, [1.0, float("nan")]), (n + 3, [float("inf")]), (None, [1.0] * 6),
             (1, rows[1][1]), (2, rows[0][1]), (n + 4, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).repartition(3)
    got = topk.exact_top_k(df, 5, F.col("vec_id") % 10 == 0)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top(rows, 5, 10)
    assert topk.exact_top_k(df.limit(0), 5, F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_with_large_components(spark):
    rows = [(i, [float(2 ** 20 + i), float(-i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(topk.exact_top_k(df, 3, F.col("vec_id") % 10 == 0), "query_id", "rank", "vec_id", "score")
    assert got == brute_top(rows, 3, 10)


def fill(sizes):
    """Targets by cutting sources one round after the other."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_names, left = {}, list(names), float(sum(sizes.values()))
    while open_names:
        level = left / sum(weight[s] for s in open_names)
        over = [s for s in open_names if level * weight[s] > 3 * sizes[s]]
        if not over:
            target.update((s, level * weight[s]) for s in open_names)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_names.remove(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 1, "d": 0, None: 40},
                                   {"b": 10_000, "a": 3, "é": 200, "Z": 77, "c": 1, "d": 2}, {"x": 0}])
def test_source_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_mixing(spark, docs, no_docs, rows):
    got = rows_of(mixing.mixed_documents(docs), "doc_id", "size", "source_size", "target", "taken")
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    assert sum(r[1] for r in got) == sum(sizes.values()) and len(got) == len(rows)
    by_target = {}
    for i, size, source_size, target, taken in got:
        assert 0 <= taken <= 3 * size
        key = (source_size, round(target, 3))
        by_target[key] = by_target.get(key, 0) + taken
    for s, t in want.items():
        assert abs(by_target[sizes[s], round(t, 3)] - t) <= max(3.0, 0.01 * t), s
    again = rows_of(mixing.mixed_documents(docs.repartition(7)), "doc_id", "size", "taken")
    assert again == sorted(((r[0], r[1], r[4]) for r in got), key=repr)
    assert mixing.mixed_documents(no_docs).count() == 0


def test_mixing_equals_sql(spark, rows):
    import pandas as pd

    plain = list(dict.fromkeys(rows))
    frame = pd.DataFrame(plain, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    cols, want = brute.sql(mixing.ORACLE, documents=frame)
    got = rows_of(mixing.mixed_documents(spark.createDataFrame(plain, SCHEMA)), "doc_id", "size", "source_size", "taken")
    at = [cols.index(c) for c in ("doc_id", "size", "source_size", "taken")]
    assert got == sorted((tuple(r[i] for i in at) for r in want), key=repr)


def test_schedule_prefixes_hold_the_shares(spark):
    sources = spark.createDataFrame([(0, 5000, 1000.0), (1, 5000, 3000.0), (2, 5000, 6000.0)],
                                    "idx long, source_size long, target double")
    slots = mixing.slot_schedule(spark, sources, 10_000, 4).orderBy("slot").collect()
    assert len(slots) == 2500
    for n in (100, 500, 2500):
        for idx, share in ((0, 0.1), (1, 0.3), (2, 0.6)):
            assert abs(sum(r["idx"] == idx for r in slots[:n]) - share * n) <= 4
    for idx in range(3):
        assert [r["pass"] * 1250 + r["block"] for r in slots if r["idx"] == idx] == list(range(sum(r["idx"] == idx for r in slots)))


def test_repeated_documents(docs, rows):
    per = {}
    for i, size, taken in rows_of(mixing.mixed_documents(docs), "doc_id", "size", "taken"):
        per[i] = per.get(i, 0) + (int(taken / size + 0.5) if size else 0)
    got = mixing.repeated_documents(docs)
    assert got.columns == docs.columns
    count = {}
    for (i,) in rows_of(got, "doc_id"):
        count[i] = count.get(i, 0) + 1
    assert count == {i: n for i, n in per.items() if n}


def test_line_rules_equal_sql(spark, docs, no_docs, rows):
    import pandas as pd

    common = "a boilerplate line that every page of this host repeats for ever"
    more = [(5000 + i, f"{common}\n{'' if i % 3 else 'own words ' * 3}{i}\n{common if i % 5 == 0 else ''}", "aa", "h", 1)
            for i in range(70)]
    more += [(5100 + i, f"{common}\n" + " ".join(f"w{i}x{j}" for j in range(60)), "aa", "h", 1) for i in range(9)]
    more += [(5150, "\n".join([common] * 9), "aa", "h", 1)]        # of this text nothing is left
    more += [(5200, "a b c d e f g h " * 5, "aa", "h", 1), (5201, "# $ % & | < > * " * 9, None, None, 1),
             (5202, "one two three four five six seven eight x one two three four five six seven eight y z q r s t u", "", "h", 1)]
    every = [*rows, *more]
    frame = pd.DataFrame(every, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    cols, want = brute.sql(line_rules.ORACLE, documents=frame)
    df = docs.select(*[c for c in ("doc_id", "text", "lang", "source", "n_chars")]).unionByName(
        spark.createDataFrame(more, SCHEMA)).withColumn("lines", F.lit(1))
    got = line_rules.quality_rules(df)
    assert rows_of(got, *cols) == sorted(want, key=repr)
    assert got.filter("removed_chars > 0").count() >= 70
    assert line_rules.quality_rules(no_docs).count() == 0
