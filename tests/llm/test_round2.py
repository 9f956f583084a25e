"""Whole-job cases of the second review."""

import random

from ragloom.llm import line_dedup as LD
from ragloom.llm import mixing

from . import brute
from .conftest import rows_of
from .test_join_operators import mutate


def removals(rows):
    """(exact, near) per id by all pairs: edits grow with the shorter line, short lines with a word are exact only."""
    seen = [((i, pos), i, brute.normal(x)) for i, t in rows for pos, x in enumerate(t.split("\n"))]
    seen = [x for x in seen if len(x[2]) >= 24 or any(c.isalnum() for c in x[2])]
    first = {}
    for at, _, n in seen:
        first[n] = min(at, first.get(n, at))

    def near(x, y):
        least = min(len(x), len(y))
        return least >= 24 and brute.distance_within(x, y, min(3, 1 + least // 64))

    late = {x for x in first if any(first[y] < first[x] and near(x, y) for y in first)}
    out = {i: [0, 0] for i, _ in rows}
    for at, i, n in seen:
        out[i][1 if n in late else 0] += n in late or at != first[n]
    return sorted(((i, *c) for i, c in out.items()), key=repr)


def test_line_dedup_edits_grow_with_the_line(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abc defgh") for _ in range(n)) for n in (30, 62, 64, 66, 90, 127, 129, 131, 200, 400)]
    rows = [(i, "\n".join(mutate(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(4))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(LD.line_dedup(df, short=True), "doc_id", "n_exact", "n_near") == removals(rows)


def test_short_lines_match_exactly(spark):
    rows = [(1, "Read more\n--\nshort a"), (2, "read  more\n--\nshort b"), (3, "日本\nRead more"), (4, "日本\n42\n--"), (5, "42")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, 0, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0)]
    assert removals(rows) == want
    assert rows_of(LD.line_dedup(df, short=True), "doc_id", "n_exact", "n_near") == want


def test_small_sources_reach_their_targets(spark, monkeypatch):
    """Long blocks, a hot source and small ones: every source delivers its target, in order, spread over the mix."""
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 16)
    sizes = {"a": 100, "b": 500, "c": 2100, "d": 3000, "e": 5000, "f": 1, "g": 20_000, "hot": 200_000, "z": 0}
    rows, step = [], 37
    for source, n in sizes.items():
        rows += [(len(rows) + i, "w " * min(step, n - at), source) for i, at in enumerate(range(0, n, step))]
    rows.append((99_999, "", "z"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mix = mixing.mix_sources(df)
    assert mix.block_words == 2048
    slots = -(-sum(sizes.values()) // 2048)
    target = {r["idx"]: (r["source"], r["target"]) for r in mix.sources.collect()}
    got = {}
    for r in mix.rows.collect():
        assert 0 <= r["slot"] < slots and 0 < r["words"] <= step and 0 <= r["from_word"] < step
        got[r["idx"]] = got.get(r["idx"], 0) + r["words"]
    for idx, (source, want) in target.items():
        assert abs(got.get(idx, 0) - want) <= max(3, 0.01 * want), source
    small = {s: want for s, want in target.values() if s in "abcdef"}
    assert all(want == 3 * sizes[s] for s, want in small.items())
    for r in mixing.mixed_documents(df).where("source_size < 6000").collect():
        assert r["taken"] == 3 * r["size"]
