import numpy as np
from pyspark.sql import functions as F

from ragloom.operators.embedding import embed, hash_dense, hashing_provider
from ragloom.operators.partitioning import materialize, spread
from ragloom.operators.prompts import infer


def test_embed_hook_fits_and_normalises(spark):
    df = spark.createDataFrame([(1, "Alpha beta beta"), (2, ""), (3, "x" * 9000)], "id long, text string")
    calls = spark.sparkContext.accumulator(0)

    def provider(texts):
        calls.add(len(texts))
        return [[float(len(t)), 3.0, 4.0] if t else [] for t in texts]

    out = {r.id: r.embedding for r in embed(df, provider, dim=5, input_cap=8000).collect()}
    assert len(out[1]) == 5 and np.isclose(np.linalg.norm(out[1]), 1.0)
    assert out[2] == [0.0] * 5                      # zero vector unchanged
    assert np.isclose(out[3][0] / out[3][1], (8000 + 1000) / 2 / 3.0)  # mean of its two pieces
    assert calls.value == 4


def test_python_provider_agrees_with_native_hashing(spark):
    df = spark.createDataFrame([(1, "Héllo, wörld! Hello again 42x."), (2, "Ünïcode ÄÖÜ ß straße")],
                               "id long, text string")
    native = {r.id: r.embedding for r in hash_dense(df, "id", "text", 32).collect()}
    hooked = {r.id: r.embedding for r in embed(df, hashing_provider(32), dim=32).collect()}
    for k in native:
        assert np.allclose(native[k], hooked[k])


def test_infer_computes_each_distinct_input_once(spark):
    rows = [(i, "same prompt" if i % 3 else f"prompt {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, prompt string")
    seen = spark.sparkContext.accumulator(0)

    def model(prompts):
        seen.add(len(prompts))
        return [p.upper() for p in prompts]

    out = {r.id: r.response for r in infer(df, model).collect()}
    assert out[1] == "SAME PROMPT" and out[3] == "PROMPT 3"
    assert seen.value == 11  # 10 distinct "prompt i" + 1 shared


def test_spread_and_materialize(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 64)
    assert spread(many).rdd.getNumPartitions() == 64
    m = materialize(one.withColumn("y", F.col("id") * 2))
    assert m.count() == 100 and "LogicalRDD" in m._jdf.queryExecution().logical().toString()
