"""Lexical hits, weighted prefixes and ranked contexts against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ragloom.operators import lexical, ranking, retrieval

WORDS = ["the", "and", "of"] * 6 + [f"w{i}" for i in range(60)]


def _texts(seed, n, most):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def _vector(text):
    c = Counter(t for t in re.split(r"[^\w]+", (text or "").lower()) if t)
    norm = sum(v * v for v in c.values()) ** 0.5
    return {t: v / norm for t, v in c.items()}


def _ranking(chunks, query):
    q = _vector(query)
    scored = [(round(sum(w * q.get(t, 0) for t, w in _vector(text).items()), 9), key, len(text or "")) for key, text in chunks]
    return sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1]))


@pytest.fixture(scope="module")
def tables(spark):
    chunks = [(f"c{i}", t) for i, t in enumerate(_texts(1, 150, 40))] + [("n", None), ("long", "the end " * 4000)]
    chunks += [("same1", chunks[7][1]), ("same2", chunks[7][1])]
    questions = list(enumerate(_texts(2, 40, 12))) + [(90, None), (91, "unknown words only"), (92, "")]
    c = spark.createDataFrame(chunks, "chunk_id string, text string").repartition(4)
    q = spark.createDataFrame(questions, "query_id long, query string")
    return chunks, questions, c, q


@pytest.mark.parametrize("block, rows, cells", [(1 << 19, 128, 2_000_000), (500, 3, 7)])
def test_rank_sparse_against_brute_force(tables, monkeypatch, block, rows, cells):
    chunks, questions, c, q = tables
    monkeypatch.setattr(lexical, "BLOCK_CHARS", block)
    monkeypatch.setattr(lexical, "QUESTION_ROWS", rows)
    monkeypatch.setattr(lexical, "CELLS", cells)
    got = {}
    for r in retrieval.rank_sparse(c, q, 6).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.chunk_id)
    want = {i: dict(enumerate((x[:2] for x in _ranking(chunks, t)[:6]), 1)) for i, t in questions}
    assert got == {i: x for i, x in want.items() if x}


@pytest.mark.parametrize("budget", [0, 50, 700, 1_000_000])
def test_budget_against_brute_force(tables, monkeypatch, budget):
    chunks, questions, c, q = tables
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 2000)
    hits = lexical.lexical_hits(c, q, budget=budget).checkpoint()
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.used_chars) for r in retrieval.budget_rows(hits, budget).collect())
    want = []
    for i, t in questions:
        used = -2
        for n, (_, key, size) in enumerate(_ranking(chunks, t), 1):
            used += size + 2
            if used > budget:
                break
            want.append((i, n, key, used))
    assert got == sorted(want)
    # every question with a hit is among the hits, even if its first chunk is past the budget
    assert {r.query_id for r in hits.select("query_id").collect()} == {i for i, t in questions if _ranking(chunks, t)}


def test_hits_are_cut_in_the_task(tables):
    chunks, questions, c, q = tables
    n = lexical.lexical_hits(c, q, k=3).count()
    pairs = sum(len(set(_vector(t)) & set(_vector(x))) for _, x in chunks for _, t in questions)
    print("rows out of the tasks", n, "shared postings of a posting join", pairs)
    assert n <= 3 * len(questions) * 16 and n * 5 < pairs


def test_empty_tables(tables):
    _, _, c, q = tables
    assert retrieval.rank_sparse(c.limit(0), q, 3).count() == 0
    assert retrieval.budget_rows(lexical.lexical_hits(c, q.limit(0), budget=9), 9).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 16])
def test_weighted_prefix(spark, parts):
    rng = random.Random(parts)
    rows = [(None if g == 3 else g, i, rng.choice([0, 0, 1, 5, 300, 90])) for g in range(6) for i in range([900, 40, 1, 30, 0, 2][g])]
    df = spark.createDataFrame(rows, "g long, i long, size long").repartition(5)
    for limit in (0, 250, 10 ** 9):
        got = ranking.weighted_prefix(df, ["g"], [F.col("i").desc()], F.col("size"), limit, num_partitions=parts)
        want = []
        for g in {r[0] for r in rows}:
            used = 0
            for n, (_, i, size) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]), 1):
                used += size
                if used <= limit:
                    want.append((g, i, size, n, used))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_weighted_prefix_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(g, i, 2) for g in range(3) for i in range(10)], "g long, i long, size long")
        got = ranking.weighted_prefix(df, ["g"], [F.col("i")], F.col("size"), 9, num_partitions=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.g, r.i, r["rank"], r.used) for r in got) == [(g, i, i + 1, 2 * i + 2) for g in range(3) for i in range(4)]


def test_no_text_moves_before_the_cut(spark):
    """Below the prefix sum no exchange carries a text; above it only the kept rows meet one."""
    sf = "/root/testdata/sf0.001"
    plan = E.queries()["context_budget"](spark, sf)._jdf.queryExecution().executedPlan()
    assert "text" not in plan.toString()
    lines = E.queries()["ranked_context"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in lines and "row_number" not in lines


def test_scores_are_dot_products():
    rng = np.random.default_rng(0)

    def block(n):
        v = lexical._Vectors.__new__(lexical._Vectors)
        sizes = rng.integers(1, 9, n)
        v.key, v.row = np.arange(n).astype(object), np.repeat(np.arange(n), sizes)
        v.token = np.concatenate([np.sort(rng.choice(30, s, replace=False)) for s in sizes])
        v.weight = rng.random(len(v.token))
        v.chars = np.ones(n, np.int64)
        return v

    def dense(v):
        x = np.zeros((len(v.key), 30))
        x[v.row, v.token] = v.weight
        return x

    q, c = block(13), block(50)
    np.testing.assert_allclose(lexical.block_scores(q, c), dense(c) @ dense(q).T)
