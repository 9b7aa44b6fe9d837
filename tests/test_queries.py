"""Every registered query beside its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.registry import ORACLES, QUERIES
from checks.run import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    result, *_ = compare(
        spark, tables, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR
    )
    assert result.startswith(("ok", "rows-only")), result


def test_flagship(spark):
    assert entry.entry(spark).count() == 1
