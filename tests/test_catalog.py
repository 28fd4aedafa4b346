"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SMALL

from voxara import catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _rows(frame, columns):
    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(text(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SMALL).toPandas()
    if name in catalog.oracle_sql():
        expected = duck.sql(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        columns = sorted(got.columns)
        assert _rows(got, columns) == _rows(expected, columns)
    else:
        assert len(got)
