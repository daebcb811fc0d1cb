"""Every registered query that has SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from cellwright.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, int | bool | None) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, con):
    df = catalogue.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    rel = con.sql(SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr) == want


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(SQL)
