"""Workers and the driver hold a bounded part of the texts as Python objects."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ragloom.llm import common, jaccard_join
from ragloom.llm.language_id import ContextTrees


def _peak(fn) -> int:
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_text_blocks_decode_one_range_at_a_time():
    texts = [None, "é" * 1_500, "", "a" * 5_000, None, "b", "c" * 2_000, "d" * 2_000]
    others = ["x"] * len(texts)
    got = list(common.text_blocks(pa.array(texts), pa.array(others), limit=4_000))
    assert [(a, b) for a, b, _ in got] == [(0, 3), (3, 4), (4, 7), (7, 8)]
    assert [t for _, _, (x, _) in got for t in x] == texts and [t for _, _, (_, y) in got for t in y] == others
    sliced = pa.array(texts).slice(2, 4)
    assert [t for _, _, (x,) in common.text_blocks(sliced) for t in x] == texts[2:6]
    assert list(common.text_blocks(pa.array([], pa.string()))) == []


def test_shingles_hold_one_text_of_words():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 400, 20_000)) for _ in range(20)] + [None, "", "One two"]
    words = 20 * 20_000
    shingle = jaccard_join.Shingler(4)
    assert _peak(lambda: shingle(texts)) < 40 * words      # one bytes object a word is more than 34 bytes, its place 8
    assert [len(s) for s in shingle(texts)[-3:]] == [0, 0, 1]


def test_shingles_do_not_depend_on_the_memo(monkeypatch):
    texts = [" ".join(f"w{i * j % 97}" for j in range(60)) for i in range(1, 30)] + ["x" * 200 + " y z", "a b c d e f g"]
    whole = jaccard_join.Shingler(4)(texts)
    monkeypatch.setattr(jaccard_join, "_MEMO_WORDS", 20)
    for s, t in zip(whole, jaccard_join.Shingler(4)(texts), strict=True):
        assert np.array_equal(s, t)


def test_tree_fitting_holds_one_language_of_positions():
    rng = np.random.default_rng(3)
    samples = {x: ["".join(rng.choice(list("abcdefgh "), 200_000)) for _ in range(2)] for x in ("da", "de", "en", "fr")}
    size = sum(len(t) for v in samples.values() for t in v)
    # one language's keys, their sorted copy and places, beside four bytes a position for codes and nodes of all
    assert _peak(lambda: ContextTrees.fit(samples, order=2)) < 30 * size


@pytest.mark.parametrize("samples", [{}, {"en": []}, {"en": [""], "fr": ["x"]}, {"a": ["one two"], "b": ["two one", "é ü"]}])
def test_trees_of_few_texts(samples):
    trees = ContextTrees.fit(samples, min_count=1)
    lang, score, _ = trees.predict(["one two", "", None, "é"])
    assert len(lang) == 4 and ((score >= 0) & (score <= 1)).all()
