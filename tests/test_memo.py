"""Inference results are kept between jobs and computed once per input."""

import os

from ragloom.operators import memo as memo_module
from ragloom.operators.memo import InferenceMemo
from ragloom.session import scratch_path


def _counting(folder):
    """A batch function that leaves a mark per input it is called with."""
    def fn(texts):
        import uuid

        for t in texts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(t)
        return [t.upper() for t in texts]
    return fn


def _calls(folder):
    out = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name)) as f:
            out.append(f.read())
    return sorted(out)


def test_second_run_calls_nothing(spark, tmp_path):
    memo, fn = InferenceMemo(spark, scratch_path(spark, "memo")), _counting(str(tmp_path))
    rows = [(i, f"p{i % 7}") for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "id long, prompt string").repartition(5)
    want = sorted((i, p, None if p is None else p.upper(), p is not None) for i, p in rows)
    assert sorted(map(tuple, memo.infer(df, fn, "m", new_col="new").collect())) == want
    assert _calls(tmp_path) == sorted({p for _, p in rows if p is not None})
    again = InferenceMemo(spark, memo.path)         # another job, later
    assert sorted(map(tuple, again.infer(df, fn, "m").collect())) == [w[:3] for w in want]
    assert len(_calls(tmp_path)) == 8
    more = spark.createDataFrame([(1, "p1"), (2, "q")], "id long, prompt string")
    assert sorted(map(tuple, again.infer(more, fn, "m", new_col="new").collect())) == [(1, "p1", "P1", False), (2, "q", "Q", True)]
    assert len(_calls(tmp_path)) == 9
    again.infer(more, fn, "other model")
    assert len(_calls(tmp_path)) == 11


def test_hot_input_is_dealt_to_many_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(memo_module, "HOT_ROWS", 50)
    memo = InferenceMemo(spark, scratch_path(spark, "memo-hot"))
    rows = [(i, "hot" if i % 3 else f"p{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, prompt string").repartition(4)
    got = memo.infer(df, lambda texts: [t + "!" for t in texts], "m")
    assert sorted(map(tuple, got.collect())) == sorted((i, p, p + "!") for i, p in rows)


def test_empty_table(spark):
    memo = InferenceMemo(spark, scratch_path(spark, "memo-empty"))
    df = spark.createDataFrame([], "id long, prompt string")
    assert memo.infer(df, lambda texts: texts, "m", new_col="new").count() == 0
