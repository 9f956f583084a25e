"""Both ingest queries hold every chunk, whatever the languages."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from ragloom.plans import derived as D
from ragloom.session import TABLES

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The small tables with a fifth and a null language among the documents."""
    base = tmp_path_factory.mktemp("languages")
    for t in TABLES:
        what = "*"
        if t == "documents":
            what = "* REPLACE (CASE WHEN doc_id % 5 = 0 THEN 'it' WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang)"
        duckdb.execute(f"COPY (SELECT {what} FROM read_parquet('{SF_SMALL}/{t}.parquet')) TO '{base}/{t}.parquet'")
    return str(base)


def keys(df):
    return Counter((r["collection"], r["chunk_id"]) for r in df.select("collection", "chunk_id").collect())


def test_every_language_is_ingested(spark, tables):
    want = keys(D.store_chunks(spark, tables, include_web=False))
    assert {None, "user_it_docs"} <= {c for c, _ in want}
    assert keys(E.queries()["add_if_absent"](spark, tables)) == want


def test_whole_store_is_ingested(spark, tables):
    want = keys(D.store_chunks(spark, tables))
    assert {None, "user_it_docs", "default"} <= {c for c, _ in want}
    df = E.queries()["add_if_absent_store"](spark, tables)
    assert keys(df) == want
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    got = con.execute(f"SELECT collection, chunk_id, source_type FROM ({E.oracle_sql()['add_if_absent_store']})").fetchall()
    rows = [tuple(r) for r in df.select("collection", "chunk_id", "source_type").collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, got))
    assert {t for _, _, t in rows} >= {"file", "web", "reingest"}
