"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from opslens.plans.views import TABLES, VIEWS, duck_sql, view

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from parity import compare, rows_of  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(VIEWS))
def test_view(spark, con, name):
    df = view(spark, SF_DIR, name)
    cur = con.execute(duck_sql(name))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    state, note = compare(spark, con, name, entry.queries()[name], SQL.get(name), SF_DIR)
    assert state in ("ok", "rows"), note


def test_oracles_name_queries():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
