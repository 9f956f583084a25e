"""Texts travel once, the word memo is asked once a block, lines have few segment keys."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ragloom.llm import line_dedup as LD
from ragloom.llm.common import map_text
from ragloom.llm.packing import WordEncoder

from . import brute
from .test_join_operators import mutate


def test_text_of_a_kept_struct_is_sent_once(spark):
    rows = [(i, None if i % 5 == 0 else "é" * (i * 40)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.struct("doc_id", "text").alias("row")).coalesce(1)

    def make():
        def fn(texts):
            size = sum(len((t or "").encode()) for t in texts)
            return {"n": pa.array([len(t) if t else -1 for t in texts], pa.int64()),
                    "held": pa.array([size if len(texts) > 1 else 0] * len(texts), pa.int64())}
        return fn

    got = map_text(df, ["row"], "row.text", "n long, held long", make, 4_000).select("row.*", "n", "held").collect()
    assert [(r.doc_id, r.text, r.n) for r in got] == [(i, t, len(t) if t else -1) for i, t in rows]
    assert max(r.held for r in got) <= 4_000


def test_language_stage_sends_one_text(spark, docs, capsys):
    corpus_pipeline.language_stage(spark, docs.withColumn("text", F.concat("text", F.lit(""))), "").explain(True)
    assert "__text" not in capsys.readouterr().out


class _Counted(dict):
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)


def test_word_memo_is_asked_once_a_block():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["the same words again " * 500, None, "", " \n\n a  b\tc 12,5 Ünï-cödé. ΣΑΣ 日本 \U0001f600 x\r\ny", "again words"]
    enc, tok = WordEncoder(path), Tokenizer.from_file(path)
    enc.memo = _Counted()
    for _ in range(2):
        got = [x.tolist() for x in enc(texts)]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert enc.memo.asked <= 2 * len(enc.memo)


def test_lines_have_few_keys_and_meet_over_class_bounds(spark):
    rng = random.Random(9)
    pairs = []
    for n in [*range(24, 36), *range(46, 50), *range(60, 69), *range(76, 84), *range(124, 133), *range(190, 196), 520, 1030]:
        for _ in range(8):
            a = "".join(rng.choice("abcdefgh é") for _ in range(n))
            pairs.append((a, mutate(rng, a, rng.randint(1, 3))))
    reach = lambda n: min(LD.MOST, LD.EDITS + n // LD.STEP)     # noqa: E731
    near = [(a, b, brute.distance_within(a, b, reach(min(len(a), len(b))))) for a, b in pairs
            if a != b and min(len(a), len(b)) >= LD.MIN_CHARS]
    assert sum(x for *_, x in near) > 200
    df = spark.createDataFrame(near, "a string, b string, near boolean").selectExpr("*", "length(a) m", "length(b) n")
    own = LD.allowed("{}", None)
    df = df.selectExpr("*", f"{LD.line_keys('a', 'm', None)} p", f"{LD.line_keys('b', 'n', None)} q")
    meet = "size(array_intersect({}, slice({}, 1, {} + 1)))"
    df = df.withColumn("met", F.expr(f"{meet.format('p', 'q', own.format('n'))} + {meet.format('q', 'p', own.format('m'))}"))
    assert df.filter("near and met = 0").count() == 0
    assert df.filter("size(p) > 16").count() == 0       # 26 and more before, of each line of 128 characters
    assert df.filter("m >= 128 and size(p) > 8 and pmod(m, 16) >= 3").count() == 0


@pytest.mark.parametrize("n", [100, LD.LONG_LINE - 1, LD.LONG_LINE, LD.LONG_LINE + 1, 1_500])
def test_lines_are_compared_on_both_sides_of_the_long_line(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(12):
        a = "".join(rng.choice("abcdé😀") for _ in range(n))
        rows += [(2 * i, a), (2 * i + 1, mutate(rng, a, rng.choice([1, 3, 4, 5])))]
    want = sorted(i for i, t in rows if i % 2 and t != rows[i - 1][1]
                  and brute.distance_within(rows[i - 1][1].strip(), t.strip(), min(LD.MOST, LD.EDITS + min(len(t.strip()), len(rows[i - 1][1].strip())) // LD.STEP)))
    got = LD.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_near = 1").select("doc_id")
    assert sorted(r[0] for r in got.collect()) == want
