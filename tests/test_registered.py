"""Every registered query against its SQL, on the smallest driver tables where they exist."""

import os
from decimal import Decimal

import pytest

import __spark_entry__ as registered

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    return float(value) if isinstance(value, Decimal) else value


def test_every_query_has_sql():
    assert set(registered._REGISTERED) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(registered._REGISTERED))
def test_query_agrees_with_sql(spark, database, name):
    df = registered.queries()[name](spark, FOLDER)
    cursor = database.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    expected = [tuple(normal(v) for v in row) for row in cursor.fetchall()]
    got = [tuple(normal(row[c]) for c in columns) for row in df.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_entry(spark):
    assert registered.entry(spark).count() == 6
