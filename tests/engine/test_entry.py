"""Registered queries against their SQL on the smallest tables, and the engine without the corpus package."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lineagraph.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    wanted = duck.sql(ORACLE_SQL[name])
    order = sorted(got.columns)
    assert sorted(wanted.columns) == order
    rows = lambda cols, data: sorted(repr([dict(zip(cols, r))[c] for c in order]) for r in data)
    assert rows(got.columns, map(tuple, got.collect())) == rows(wanted.columns, wanted.fetchall())


def test_entry_has_rows_and_queries_have_no_stray_sql(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert entry.oracle_sql().keys() <= entry.queries().keys()
