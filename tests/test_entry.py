import duckdb
import pytest

import __spark_entry__ as E
from ragloom.session import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "prompt", "response"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(E.ORACLE) == set(E.QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", ["chunk_documents", "hash_embedding", "topk", "html_to_text", "page_links",
                                 "scoped_context", "train_pairs", "add_if_absent", "rank_sparse", "store_topk", "chat_prompt"])
def test_queries_match_oracle_small(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[key](spark, SF)
    res = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)

    def norm(cols, rows):
        idx = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else repr(r[i]) for i in idx)
                      for r in rows)

    assert norm(df.columns, [tuple(r) for r in df.collect()]) == norm(ocols, res.fetchall())
