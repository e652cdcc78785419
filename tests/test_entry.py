import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans import oracle, queries


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(oracle.ORACLE) <= set(queries.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["semantic_search_files", "symbol_cascade", "hash_diff", "project_summary", "gap_fill", "debounce", "p5_found", "overlap_merge", "login_limits", "index_process", "percentile_nearest", "batch_topk"])
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "projects file_payloads chunks symbols search_hits documents embeddings events orders customer".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    want = con.sql(oracle.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
