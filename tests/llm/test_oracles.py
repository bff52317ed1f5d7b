"""Every SQL form against its query on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from riskloom.llm.oracles import ORACLES

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in SF_DIR.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    df = entry.queries()[name](spark, str(SF_DIR))
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str(row) for row in result.fetchall())
    assert sorted(str(tuple(row)) for row in df.select(*columns).collect()) == want and want
