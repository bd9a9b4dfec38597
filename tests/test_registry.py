"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlens.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 7) + 0.0
    return v.date() if isinstance(v, dt.datetime) else v


def same(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    got = same(df.columns, df.collect())
    if name in registry.SQL:
        found = oracle.execute(registry.SQL[name])
        assert got == same([c[0] for c in found.description], found.fetchall())
    else:
        assert got[1]


@pytest.mark.parametrize("name", ["a6_j9_frozen_subawards", "a6_terminated_subawards"])
def test_subawards_without_ids(spark, tmp_path, name):
    """One line of each order has no number, so that its sub-award has no id; the SQL has no ties there."""
    con = duckdb.connect()
    for file in os.listdir(SF):
        if file != "lineitem.parquet":
            os.symlink(f"{SF}/{file}", tmp_path / file)
    con.execute(f"COPY (SELECT * EXCLUDE (n) REPLACE (CASE WHEN n > 1 THEN l_linenumber END AS l_linenumber) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_suppkey) AS n FROM '{SF}/lineitem.parquet')) TO '{tmp_path}/lineitem.parquet'")
    for file in os.listdir(tmp_path):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tmp_path}/{file}')")
    df = registry.QUERIES[name](spark, str(tmp_path))
    found = con.execute(registry.SQL[name])
    assert same(df.columns, df.collect()) == same([c[0] for c in found.description], found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
