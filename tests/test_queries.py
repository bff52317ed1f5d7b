"""Every registered query against its SQL form on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from riskloom.queries import QUERIES as OWN
from riskloom.queries_sql import ORACLES as OWN_SQL

SF_DIR = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(round(float(value), 6))
    return str(value)


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def test_all_sql_forms_belong_to_queries():
    assert set(OWN) == set(OWN_SQL)
    assert set(OWN) <= set(QUERIES) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF_DIR))
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_by_name(df.columns, df.collect()) == rows_by_name(columns, expected)
    assert expected


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
