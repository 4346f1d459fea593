"""Registered queries beside their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from changewatch.plans import catalog
from check import TABLES, cell

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


# run_counts is an aggregate over two_runs; one of the two long queries is enough here.
# Queries of the optional subpackage are tested in tests/llm.
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"run_counts"}))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    got = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in got.description]
    order = sorted(cols)
    assert order == sorted(df.columns)
    want = sorted(tuple(cell(dict(zip(cols, r))[c]) for c in order) for r in got.fetchall())
    assert sorted(tuple(cell(r[c]) for c in order) for r in rows) == want and rows


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "content_changed" in df.columns
