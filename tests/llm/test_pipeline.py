"""Every pipeline stage against a brute-force version on what its predecessor kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as P
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ragloom.llm.language_id import language_id

from . import brute
from .conftest import rows_of


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """name -> (input, output) of a run over the small table, each output written and read again."""
    out, base, now = {}, tmp_path_factory.mktemp("stages"), docs
    for name, stage in P.STAGES:
        path = str(base / name)
        stage(spark, now, "unused").write.parquet(path)
        out[name] = (now, spark.read.parquet(path))
        now = out[name][1]
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages, docs):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == docs.columns


def test_language_stage(stages):
    before, after = stages["language_id"]
    sure = {r["doc_id"]: r["lang_pred"] != "und" and r["score"] >= 0.5 for r in language_id(before).collect()}
    want = sorted((d for d in texts(before) if sure[d[0]]), key=repr)
    assert rows_of(after, "doc_id", "text") == want
    for i, t in texts(before):      # clean documents stay, texts without a letter go
        assert (i, t) in want or not t or len(t) < 40 or not re.search(r"[^\W\d_]", t)


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    rows = texts(before)
    gone = brute.line_removals(rows, None, short=True)
    want = []
    for i, t in rows:
        out = gone[i, t][0] | gone[i, t][1]
        text = t if not out else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in out)
        if not out or text.strip():
            want.append((i, text))
    assert rows_of(after, "doc_id", "text") == sorted(want, key=repr)
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    rows = sorted(set(texts(before)), key=lambda d: (d[0] is None, d[0] or 0))
    head, _ = brute.components([t for _, t in rows], 5, 80)
    want = sorted((d for i, d in enumerate(rows) if head[i] == i), key=repr)
    assert rows_of(after, "doc_id", "text") == want


def test_mixing_stage(stages):
    from ragloom.llm.mixing import ORACLE

    before, after = stages["mixing"]
    frame = before.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})
    cols, got = brute.sql(ORACLE, documents=frame)
    per = Counter()
    for row in got:
        r = dict(zip(cols, row, strict=True))
        per[r["doc_id"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
    assert Counter(i for i, _ in texts(after)) == Counter({i: n for i, n in per.items() if n})
    assert set(texts(after)) <= set(texts(before))


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after = stages["packing"]
    want = Counter()
    for i, t in texts(before):
        want[i] += len(lib.encode(t, add_special_tokens=False).ids) + 1
    got, per_seq = Counter(), defaultdict(list)
    for r in after.collect():
        got[r["doc_id"]] += r["length"]
        per_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in per_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_run(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
    assert P.ORACLE_SQL is None


def test_empty_table(spark, no_docs):
    now = no_docs
    for _, stage in P.STAGES:
        now = stage(spark, now, "unused").checkpoint()
        assert now.count() == 0
