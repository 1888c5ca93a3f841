"""Every query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from termloom import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_and_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    if name not in queries.SQL:
        assert got.count() > 0
        return
    want = con.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), want.columns) == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_entry(spark):
    assert {r["file"] for r in entry.entry(spark).collect()} >= {"taxonomy-part-type.ttl"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
