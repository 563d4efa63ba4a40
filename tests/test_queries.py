"""Registered queries against their DuckDB twins on the smallest driver tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_point  # noqa: E402
from check import TABLES, compare  # noqa: E402

SF_DIR = entry_point.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, duck, name):
    ok, note, _ = compare(spark, duck, name, entry_point.queries()[name], entry_point.oracle_sql().get(name), SF_DIR)
    assert ok, note


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["query_id", "pos", "id", "source", "category", "similarity", "rrf_score"]
