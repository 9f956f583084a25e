"""Deliveries are told apart per document, across batches, layouts and failures."""

import itertools

import duckdb
import pytest
import __spark_entry__ as E
from ragloom.operators.chunking import explode_chunks
from ragloom.operators.ledger import IngestLedger, ingest_documents
from ragloom.operators.store import ChunkStore
from ragloom.session import TABLES, scratch_path

from .conftest import SF_SMALL

COLS = "collection string, doc_key string, source string, text string, delivery long"


def _chunk(docs):
    return explode_chunks(docs, "doc_key", "text", 10, "\n", keep=["collection", "source"])


def _place(spark):
    return ChunkStore(spark, scratch_path(spark, "ledger-store")), IngestLedger(spark, scratch_path(spark, "ledger"))


def _texts(st):
    return {k: [r.text for r in g] for k, g in itertools.groupby(
        sorted(st.read().collect(), key=lambda r: (repr(r.collection), r.doc_key, r.chunk_index)), key=lambda r: (r.collection, r.doc_key))}


def _send(spark, place, rows, parts=2, **kw):
    got = ingest_documents(spark.createDataFrame(rows, COLS).repartition(parts), *place, _chunk, **kw)
    return sorted(((r.doc_key, r.source, r.delivery, r.status, r.chunks) for r in got.collect()), key=repr)


def test_deliveries_are_told_apart(spark):
    place = _place(spark)
    long, short, other = "aaaaaaaa\nbbbbbbbb\ncccccccc", "AAAAAAAA", "xxxxxxxx\nyyyyyyyy"
    assert _send(spark, place, [("c", "k", "a/k", short, 1), (None, "k", "a/k", other, 1), ("c", "n", None, None, 1)]) == [
        ("k", "a/k", "1", "new", 1), ("k", "a/k", "1", "new", 2), ("n", None, "1", "new", 0)]
    assert _send(spark, place, [("c", "k", "a/k", short, 2), ("c", "k", "a/k", long, 2), ("c", "k", "b/k", other, 2),
                                ("c", "n", None, "", 2)]) == [
        ("k", "a/k", "2", "changed", 0), ("k", "a/k", "2", "replay", 0), ("k", "b/k", "2", "collision", 0),
        ("n", None, "2", "replay", 0)]
    assert _texts(place[0])[("c", "k")] == [short]                      # the longer one added no tail
    assert _send(spark, place, [("c", "k", "a/k", long, 3), ("c", "k", "a/k", long + "\nd", 4)], replace=True) == [
        ("k", "a/k", "3", "changed", 0), ("k", "a/k", "4", "replaced", 3)]
    assert _texts(place[0])[("c", "k")] == ["aaaaaaaa", "bbbbbbbb", "cccccccc\nd"]
    assert _send(spark, place, [("c", "k", "a/k", long + "\nd", 5), ("c", "k", "a/k", short, 5)]) == [
        ("k", "a/k", "5", "changed", 0), ("k", "a/k", "5", "replay", 0)]
    assert _texts(place[0])[(None, "k")] == other.split("\n")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_one_page_crawled_twice_never_mixes(spark, parts):
    versions = ["\n".join(f"{v}{i:07d}" for i in range(n)) for v, n in (("a", 4), ("b", 6), ("c", 2))]
    place = _place(spark)
    got = _send(spark, place, [("c", "u", "http://u", t, d) for t, d in zip(versions, (2, 1, 1), strict=True)], parts)
    first = min(range(1, 3), key=lambda i: __import__("hashlib").sha256(versions[i].encode()).hexdigest())
    assert _texts(place[0]) == {("c", "u"): versions[first].split("\n")}
    assert sorted(r[3] for r in got) == ["changed", "changed", "new"]


def test_interrupted_batch_is_finished_with_the_admitted_content(spark, monkeypatch):
    place = _place(spark)
    good, longer = "aaaaaaaa\nbbbbbbbb", "zzzzzzzz\nyyyyyyyy\nxxxxxxxx"

    def lost(*a, **k):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(ChunkStore, "add", lost)
        with pytest.raises(RuntimeError):
            _send(spark, place, [("c", "k", "a/k", good, 1)])
    assert _send(spark, place, [("c", "k", "a/k", longer, 2)]) == [("k", "a/k", "2", "changed", 0)]
    assert _texts(place[0]) == {}
    again = IngestLedger(spark, place[1].path)          # as after a restart
    assert _send(spark, (place[0], again), [("c", "k", "a/k", good, 3), ("c", "k", "a/k", good, 3)]) == [
        ("k", "a/k", "3", "replay", 0), ("k", "a/k", "3", "replay", 2)]
    assert _texts(place[0]) == {("c", "k"): good.split("\n")}
    assert _send(spark, place, [("c", "k", "a/k", good, 4)]) == [("k", "a/k", "4", "replay", 0)]


def test_query_on_any_table(spark, tmp_path):
    """The registered query against its SQL where documents repeat, change and collide, with null columns."""
    for t in TABLES:
        what = "*"
        if t == "documents":
            what = ("* REPLACE (CASE WHEN doc_id % 8 = 1 THEN 'same text' WHEN doc_id % 8 = 0 THEN 'same text' ELSE text END AS text, "
                    "CASE WHEN doc_id % 4 < 2 THEN 'src' WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS source, "
                    "CASE WHEN doc_id % 14 < 2 THEN NULL ELSE 'en' END AS lang)")
        duckdb.execute(f"COPY (SELECT {what} FROM read_parquet('{SF_SMALL}/{t}.parquet')) TO '{tmp_path}/{t}.parquet'")
    cols = ["doc_id", "delivery", "status", "chunks"]
    got = [tuple(r) for r in E.queries()["ingest_ledger"](spark, str(tmp_path)).select(cols).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()['ingest_ledger']})").fetchall()
    assert sorted(got) == sorted(want)
    assert {r[2] for r in got} == {"new", "replay", "changed", "collision", "replaced"} and sum(r[3] for r in got) > 0


def test_ledger_edges(spark):
    place = _place(spark)
    assert _send(spark, place, []) == []
    assert place[1].current().count() == 0


def test_files_of_one_base_name(spark, tmp_path):
    """Files through the ledger: a longer re-delivery and a colliding base name add no chunk."""
    from ragloom import workflows

    def deliver(name, files):
        for path, body in files.items():
            (tmp_path / name / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / path).write_text(body)
        got = workflows.ingest_path(spark, str(tmp_path / name), st, username="u", ledger=ledger, delivery=name, every_file=True)
        return sorted((r.path.split(name + "/")[1], r.status, r.chunks, r.delivery_status) for r in got.collect())

    st, ledger = _place(spark)
    long = "a" * 900 + "\n\n" + "b" * 900
    assert deliver("1", {"x.txt": "short", "e.txt": "", "bad.json": "{"}) == [
        ("bad.json", "error", 0, None), ("e.txt", "success", 1, "new"), ("x.txt", "success", 1, "new")]
    assert deliver("2", {"x.txt": long, "sub/x.txt": "other"}) == [
        ("sub/x.txt", "success", 0, "collision"), ("x.txt", "success", 0, "collision")]
    assert sorted(r.text for r in st.read().collect()) == ["This is an empty text file.", "short"]
