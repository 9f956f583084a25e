"""Property tests of the native expressions on hypothesis-generated batches (one Spark job per batch)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.functions.text import py_strip, squash_lines
from ragloom.operators.chunking import chunk_text
from tests.test_chunking import check_packing
from tests.test_text import check_squash

PIECES = st.sampled_from(["a", "Bc", "é", "😀", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\r", "\x0b",
                          "\x0c", "\x1c", "\x1f", "\x85", " ", " ", "　", "​", "|"])
TEXTS = st.lists(PIECES, max_size=40).map("".join)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(batch=st.lists(TEXTS, min_size=1, max_size=60), size=st.integers(1, 30),
       sep=st.sampled_from(["\n\n", "\n", "|", "a"]))
def test_chunk_text_property(spark, batch, size, sep):
    df = spark.createDataFrame(list(enumerate(batch)), "id long, t string")
    got = dict(df.select("id", chunk_text(F.col("t"), size, sep).alias("c")).collect())
    for i, t in enumerate(batch):
        check_packing(t, size, sep, list(got[i]))


@SETTINGS
@given(batch=st.lists(TEXTS, min_size=1, max_size=60))
def test_squash_and_strip_property(spark, batch):
    df = spark.createDataFrame(list(enumerate(batch)), "id long, t string")
    rows = df.select("id", squash_lines(F.col("t")).alias("q"), py_strip(F.col("t")).alias("s")).collect()
    for r in rows:
        t = batch[r.id]
        check_squash(t, r.q)
        assert r.s == t.strip(), repr(t)
