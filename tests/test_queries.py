"""Every registered query against its SQL in DuckDB, on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as driver
from check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.QUERIES)))
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, FOLDER)
    result = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.collect(), df.columns) == canonical(result.fetchall(), columns)


def test_every_query_has_sql():
    assert set(driver.queries()) - set(driver.QUERIES) == set(driver.oracle_sql()) - set(driver.SQL)


def test_entry(spark):
    assert not driver.entry(spark).isEmpty()
