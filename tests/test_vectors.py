import numpy as np
from pyspark.sql import functions as F

from ragloom.functions.vectors import fit_dimension, l2_normalize, squared_l2


def test_fit_and_normalize(spark):
    rows = [(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [1.0] * 70), (3, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    for dim in (32, 64, 100):
        got = dict(df.select("id", l2_normalize(fit_dimension(F.col("v"), dim)).alias("w")).collect())
        for i, v in rows:
            e = (list(v) + [0.0] * max(0, dim - len(v)))[:dim]
            n = np.linalg.norm(e)
            exp = [x / n for x in e] if n > 0 else e
            assert np.allclose(got[i], exp) and len(got[i]) == dim


def test_squared_l2(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(squared_l2("a", "b").alias("d")).first().d == 5.0
