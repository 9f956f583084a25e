"""A reused worker does not hold what an earlier operator remembers; the library encodes few texts at once."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from ragloom.llm import common, packing
from ragloom.llm.packing import BATCH, WordEncoder, encoder


class _Captured:
    """A frame that gives the function of its tasks."""

    schema = StructType().add("doc_id", "long").add("text", "string")

    def select(self, *columns):
        return self

    def mapInArrow(self, fn, schema):
        return fn


def test_a_stage_lets_go_of_what_packing_remembers(spark, monkeypatch):
    monkeypatch.setattr(common, "_KEPT", {})
    path = public_tokenizers.path("word_bpe_49k.json")
    own = encoder(path)
    assert encoder(path) is own             # one for all tasks of the stage
    seen = []

    def make():
        seen.append(len(common._KEPT))
        return lambda texts: {"n": pa.array([len(t or "") for t in texts], pa.int64())}

    run = common.map_text(_Captured(), ["doc_id"], "text", "n long", make)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["abc", None])], names=["doc_id", "text"])
    assert [x for b in run([batch]) for x in b.column("n").to_pylist()] == [3, 0]
    assert seen == [0]
    assert encoder(path) is not own and list(common._KEPT) == [("words", path)]


def test_kept_holds_one_thing(monkeypatch):
    monkeypatch.setattr(common, "_KEPT", {})
    a = common.kept("a", list)
    assert common.kept("a", list) is a
    common.kept("b", dict)
    assert list(common._KEPT) == ["b"] and common.kept("a", list) is not a


def test_the_library_encodes_few_texts_at_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = " ".join(f"{i}-x{i * 7 % 10_007}" for i in range(5_000))
    enc, tok = WordEncoder(path), Tokenizer.from_file(path)
    sizes, whole = [], enc.tok

    class Counted:
        def encode_batch_fast(self, texts, **named):
            sizes.append(len(texts))
            return whole.encode_batch_fast(texts, **named)

    enc.tok = Counted()
    assert enc([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids + [1]
    assert sum(sizes) >= 5_000 and max(sizes) <= BATCH


def test_normalised_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "BASE_WORDS", 100)
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, tok = WordEncoder(path), Tokenizer.from_file(path)
    for k in range(6):
        text = " ".join(f"{''.join(chr(97 + int(d)) for d in str(i))}." for i in range(k * 150, k * 150 + 200))
        assert enc([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids + [1]
        assert len(enc.base) <= 100 + 202
