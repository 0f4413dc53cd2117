"""Every query with SQL returns the rows that DuckDB returns for it."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from normlake import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return connection


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA).toPandas()
    assert len(found)
    if name in registry.ORACLES:
        assert rows(found) == rows(duck.sql(registry.ORACLES[name]).df())
