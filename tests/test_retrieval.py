import numpy as np
from pyspark.sql import functions as F

from ragloom.operators import retrieval, vafile
from ragloom.operators.ranking import distributed_row_number


def _data(spark, n=300, q=7, dim=16, seed=0):
    rnd = np.random.default_rng(seed)
    vecs = rnd.normal(size=(n, dim))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    vecs[5] = vecs[6]  # exact duplicate vectors tie on distance
    qs = rnd.normal(size=(q, dim))
    qs /= np.linalg.norm(qs, axis=1, keepdims=True)
    qs[0] = vecs[10]
    stored = spark.createDataFrame([(i, str(i % 4), vecs[i].tolist()) for i in range(n)],
                                   "vec_id long, collection string, embedding array<double>").repartition(5)
    questions = spark.createDataFrame([(100 + j, qs[j].tolist()) for j in range(q)],
                                      "query_id long, embedding array<double>")
    return vecs, qs, stored, questions


def _brute(vecs, qs, k=None):
    out = {}
    for j, qv in enumerate(qs):
        d = ((vecs - qv) ** 2).sum(1)
        s = np.maximum(0, 1 - d)
        order = sorted(range(len(vecs)), key=lambda i: (-s[i], str(i % 4), d[i], i))
        out[100 + j] = order[:k] if k else order
    return out


def test_topk_matches_brute_force(spark):
    vecs, qs, stored, questions = _data(spark)
    got = retrieval.topk(stored, questions, 5).collect()
    exp = _brute(vecs, qs, 5)
    for r in got:
        assert exp[r.query_id][r.rank - 1] == r.vec_id
    assert len(got) == 5 * len(qs)


def test_rank_all_of_given_pairs(spark):
    vecs, qs, stored, questions = _data(spark, n=120, q=3)
    pairs = stored.select("vec_id").crossJoin(questions.select("query_id")).where("vec_id % 2 = 0 OR query_id = 100")
    got = retrieval.rank_all(retrieval.score_pairs(stored, questions, pairs)).collect()
    exp = _brute(vecs, qs)
    assert len(got) == 120 + 60 * 2
    for r in got:
        order = [i for i in exp[r.query_id] if i % 2 == 0 or r.query_id == 100]
        assert order[r["rank"] - 1] == r.vec_id
        assert np.isclose(r.distance, ((vecs[r.vec_id] - qs[r.query_id - 100]) ** 2).sum(), atol=1e-8)


def test_topk_over_many_blocks(spark, monkeypatch):
    vecs, qs, stored, questions = _data(spark, n=90, q=9)
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 8)
    monkeypatch.setattr(vafile, "QUESTION_ROWS", 2)
    got = retrieval.topk(stored, questions, 3).collect()
    exp = _brute(vecs, qs, 3)
    assert len(got) == 27
    for r in got:
        assert exp[r.query_id][r["rank"] - 1] == r.vec_id


def test_topk_is_exact_for_large_norms(spark):
    """Norms that hide the differences from a |v|^2 + |q|^2 - 2vq shortcut."""
    rnd = np.random.default_rng(3)
    vecs = 1e4 + np.round(rnd.normal(size=(400, 8)), 3)
    q = 1e4 + np.round(rnd.normal(size=8), 3)
    stored = spark.createDataFrame([(f"c{i}", "x", vecs[i].tolist()) for i in range(400)],
                                   "vec_id string, collection string, embedding array<double>")
    questions = spark.createDataFrame([("q", q.tolist())], "query_id string, embedding array<double>")
    d = np.round(((vecs - q) ** 2).sum(1), 9)
    want = sorted(range(400), key=lambda i: (-max(0.0, 1 - d[i]), d[i], f"c{i}"))[:5]
    got = retrieval.topk(stored, questions, 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [f"c{i}" for i in want]


def test_few_exact_distances(spark):
    """Whatever the layout the same rows; the share of pairs whose distance is computed."""
    rnd = np.random.default_rng(11)
    vecs = rnd.normal(size=(4000, 32))
    vecs = 0.3 * vecs / np.linalg.norm(vecs, axis=1, keepdims=True) + rnd.normal(size=(8, 32))[rnd.integers(0, 8, 4000)]
    stored = spark.createDataFrame([(f"v{i}", str(i % 3), vecs[i].tolist()) for i in range(4000)],
                                   "vec_id string, collection string, embedding array<double>")
    questions = spark.createDataFrame([(j, (vecs[j * 97] + 0.01).tolist()) for j in range(20)],
                                      "query_id long, embedding array<double>")
    shares, results = [], []
    for parts in (1, 16):
        s = stored.repartition(parts).select(F.col("vec_id").alias("i"), F.col("collection").alias("c"), F.col("embedding").alias("v"))
        q = questions.select(F.col("query_id").alias("qi"), F.col("embedding").alias("qv"))
        shares.append(vafile.candidates(s, q, 5).count() / (4000 * 20))
        results.append(sorted((r.query_id, r["rank"], r.vec_id) for r in retrieval.topk(stored.repartition(parts), questions, 5).collect()))
    print("share of exact distances", shares)
    assert results[0] == results[1] and max(shares) < 0.02
    for j in range(20):
        d = np.round(((vecs - vecs[j * 97] - 0.01) ** 2).sum(1), 9)
        want = sorted(range(4000), key=lambda i: (-max(0.0, 1 - d[i]), str(i % 3), d[i], f"v{i}"))[:5]
        assert [v for q, _, v in results[0] if q == j] == [f"v{i}" for i in want]


def test_bounds_hold():
    rnd = np.random.default_rng(2)
    for scale in (1e-6, 1.0, 1e5):
        x, q = rnd.normal(size=(200, 24)) * scale + scale, rnd.normal(size=(30, 24)) * scale
        x[0], x[1] = 7.0 * scale, 0.0       # a constant vector and none
        lower, upper = vafile.bounds(q, *vafile.quantise(x))
        d = ((q[:, None] - x) ** 2).sum(2)
        assert (lower <= d).all() and (d <= upper).all()
    odd = np.array([[np.nan, 1.0], [np.inf, 0.0], [1.0, 2.0]])
    lower, upper = vafile.bounds(np.array([[0.0, 0.0], [np.nan, 0.0]]), *vafile.quantise(odd))
    assert (upper[0, :2] == np.inf).all() and upper[0, 2] < 6 and (lower[0, :2] < 0).all() and upper[1, 2] == np.inf


def test_topk_with_repeated_rows(spark):
    rows = [(1, "a", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0]), (2, None, [1.0, 0.0]), (3, "b", [])]
    stored = spark.createDataFrame(rows, "vec_id long, collection string, embedding array<double>")
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, []), (3, None)], "query_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.collection, r.distance) for r in retrieval.topk(stored, questions, 4).collect())
    assert got == [(1, 1, 2, None, 0.0), (1, 2, 1, "a", 0.0), (1, 3, 1, "a", 0.0), (1, 4, 1, "a", 2.0), (2, 1, 3, "b", 0.0)]


def test_topk_edges(spark):
    _, _, stored, questions = _data(spark, n=12, q=2)
    assert retrieval.topk(stored.limit(0), questions, 3).count() == 0
    assert retrieval.topk(stored, questions.limit(0), 3).count() == 0
    odd = stored.unionByName(spark.createDataFrame([(50, "z", None), (51, "z", [1.0])], stored.schema))
    assert retrieval.topk(odd, questions, 20).count() == 24


def test_distributed_row_number_on_skewed_groups(spark):
    # one group holds most rows; it is spread over many range partitions
    rows = [(0 if i % 10 else 1 + i % 3, (i * 7919) % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, v long, id long")
    out = distributed_row_number(df, ["g"], [F.col("v").desc(), F.col("id")], num_partitions=7).collect()
    by = {}
    for g, v, i in rows:
        by.setdefault(g, []).append((-v, i))
    exp = {(g, i): n + 1 for g, lst in by.items() for n, (_, i) in enumerate(sorted(lst))}
    assert len(out) == 3000
    for r in out:
        assert r["rank"] == exp[(r.g, r.id)]


def test_topk_plan_uses_group_limit(spark):
    _, _, stored, questions = _data(spark, n=40, q=2)
    plan = retrieval.topk(stored, questions, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "AdaptiveSparkPlan" in plan
    plan = retrieval.topk(stored, questions, 3)._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rank_sparse(spark):
    chunks = spark.createDataFrame([("a", "red fish, red boat"), ("b", "Red fish"), ("c", "green"), ("d", "")],
                                   "chunk_id string, text string")
    qs = spark.createDataFrame([(1, "red fish"), (2, "nothing here"), (3, None)], "query_id long, query string")
    got = [(r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in
           retrieval.rank_sparse(chunks, qs, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "b", 1.0), (1, 2, "a", round(3 / (6 ** 0.5 * 2 ** 0.5), 6))]


def test_context_budget_prefix(spark):
    rows = [(1, i, "x" * 10) for i in range(10)]
    df = spark.createDataFrame(rows, "query_id long, pos long, text string")
    kept = retrieval.context_budget(df, [F.col("pos")], budget=35)
    # 10 + 2 + 10 + 2 + 10 = 34 <= 35, a fourth text would need 46
    assert sorted(r.pos for r in kept.collect()) == [0, 1, 2]
    ctx = retrieval.ordered_concat(kept, ["query_id"], "_r").first().context
    assert ctx == "\n\n".join(["x" * 10] * 3)


def test_budget_does_not_depend_on_the_layout(spark):
    rows = [(1, i, "x" * n) for i, n in enumerate([5000, 1000, 4000, 500])]
    df = spark.createDataFrame(rows, "query_id long, pos long, text string")
    for parts in (1, 2, 4, 16):
        kept = retrieval.context_budget(df.repartition(parts, "pos"), [F.col("pos")], budget=8000)
        assert sorted(r.pos for r in kept.collect()) == [0, 1]


def test_budget_counts_empty_texts(spark):
    df = spark.range(6000).select(F.lit(1).alias("query_id"), "id", F.lit("").alias("text"))
    assert retrieval.context_budget(df, [F.col("id")], budget=8000).count() == 4001


def test_scoped_context_is_whole_on_any_layout(spark):
    rows = [("user_a_docs", f"d{d}_{i}", f"d{d}", i, f"name{d}", f"f{d % 2}", "t" * (900 if d == 1 else 3))
            for d in range(4) for i in range(30)]
    chunks = spark.createDataFrame(rows, "collection string, chunk_id string, doc_key string, chunk_index long, "
                                         "document_name string, folder_name string, text string")
    reqs = spark.createDataFrame([(1, "a", None, None), (2, "a", "f1", ""), (3, "a", None, "name1"), (4, "a", "f0", "name1"),
                                  (5, "b", None, None), (6, "a", None, "name1")],
                                 "query_id long, username string, folder_name string, document_name string")
    want = {'["U","user_a_docs","",""]': rows, '["F","user_a_docs","f1",""]': [r for r in rows if r[5] == "f1"],
            '["D","user_a_docs","","name1"]': [r for r in rows if r[4] == "name1"]}
    for parts in (1, 16):
        got = {}
        for r in retrieval.scoped_context(chunks.repartition(parts), reqs).collect():
            got.setdefault(r.scope, []).append((r.pos, r.chunk_id, r.text))
        assert {s: sorted(x) for s, x in got.items()} == {
            s: [(p, r[1], r[6]) for p, r in enumerate(sorted(x, key=lambda r: (r[2], r[3])))] for s, x in want.items()}


def test_scopes_of_names_with_separators(spark):
    """Folder x|y with document z is not folder x with document y|z, nor any quoting of them."""
    chunks = spark.createDataFrame(
        [("user_a_docs", "c1", "k1", 0, "z", "x|y", "foreign"), ("user_a_docs", "c2", "k2", 0, 'y","z', "x", "foreign"),
         ("user_a_docs", "c3", "k3", 0, None, None, "none"), (None, "c4", "k4", 0, "z", "x", "no user")],
        "collection string, chunk_id string, doc_key string, chunk_index long, document_name string, "
        "folder_name string, text string")
    reqs = spark.createDataFrame(
        [(1, "a", "x", "y|z"), (2, "a", "x|y", "z"), (3, "a", "x", 'y","z'), (4, "a", 'x","y', "z"), (5, None, "x", "z")],
        "query_id long, username string, folder_name string, document_name string")
    asked = retrieval.request_scopes(reqs).select("query_id", "scope")
    got = retrieval.scoped_context(chunks, reqs).join(asked, "scope").collect()
    assert sorted((r.query_id, r.chunk_id) for r in got) == [(2, "c1"), (3, "c2")]


def test_cosine_metric(spark):
    rnd = np.random.default_rng(5)
    vecs = rnd.normal(size=(80, 8)) * rnd.uniform(0.5, 3, size=(80, 1))  # not unit length
    qs = rnd.normal(size=(3, 8))
    stored = spark.createDataFrame([(i, "c", vecs[i].tolist()) for i in range(80)],
                                   "vec_id long, collection string, embedding array<double>")
    questions = spark.createDataFrame([(j, qs[j].tolist()) for j in range(3)],
                                      "query_id long, embedding array<double>")
    got = retrieval.topk(stored, questions, 4, metric="cosine").collect()
    for r in got:
        q = qs[r.query_id]
        cos = vecs @ q / (np.linalg.norm(vecs, axis=1) * np.linalg.norm(q))
        order = sorted(range(80), key=lambda i: (-max(0.0, cos[i]), "c", 1 - cos[i], i))
        assert order[r.rank - 1] == r.vec_id
        assert np.isclose(r.distance, 1 - cos[r.vec_id]) and np.isclose(r.similarity, max(0, cos[r.vec_id]))


def test_chunks_are_packed_and_hashed_once(spark, tmpdir_path):
    from ragloom.operators.embedding import hash_dense
    from ragloom.plans import derived

    rows = [(1, "en", "s", "one two\nthree"), (2, "fr", None, "two two four"), (2, "en", "s", "five"), (2, "en", "s", "five"),
            (None, "en", "s", "no id"), (4, None, "s", None)]
    for name, docs in (("twice", rows), ("plain", rows[:2])):
        path = f"{tmpdir_path}/{name}"
        spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{path}/documents.parquet")
        c = derived.doc_chunks(spark, path).select("chunk_id", "collection", "text")
        want = c.join(hash_dense(c, "chunk_id", "text", 8), "chunk_id")
        got = derived.chunk_embeddings(spark, path, 8)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
        assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stored_vectors_are_not_shuffled_for_few_pairs(spark, monkeypatch):
    from ragloom.operators import partitioning

    vecs, qs, stored, questions = _data(spark, n=3000, q=7)
    stored, questions = partitioning.written(stored, "stored"), partitioning.written(questions, "questions")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")       # below the stored table
    try:
        for rows, joins in ((100_000, 0), (3, 1)):
            monkeypatch.setattr(partitioning, "BROADCAST_ROWS", rows)
            hits = retrieval.topk(stored, questions, 5)
            assert hits._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == joins
            want = _brute(vecs, qs, 5)
            assert sorted((r.query_id, r["rank"], r.vec_id) for r in hits.collect()) == sorted(
                (q, n, i) for q, ids in want.items() for n, i in enumerate(ids, 1))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_store_topk_removes_its_scratch_tables(spark, tmpdir_path):
    import os

    from ragloom.plans.queries import QUERIES

    docs = [(1, "one two\nthree", "en", "s"), (2, "two two four", "fr", None), (2, "five", "en", "s"), (None, "no id", "en", "s")]
    asked = [(0, "two four"), (1, "five"), (2, None)]
    for name, rows in (("twice", docs), ("plain", docs[:2])):
        path = f"{tmpdir_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
        before = set(os.listdir(shared))
        hits = QUERIES["store_topk"](spark, path)
        left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before}
        assert not left & {"chunk-vectors", "repeated-chunks", "topk-bounds", "store-hits"}
        texts = {r.chunk_id: r.text for r in hits.where("query_id = 0 AND rank = 1").collect()}
        assert texts == {"2_doc_0": "two two four"} or name == "twice" and set(texts) == {"2_doc_0"}
