"""Registered queries against their SQL statements on the smallest tables, where these are present."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as contract

TABLES = Path("/root/testdata/sf0.001")
NAMES = "documents labels embeddings lineitem orders events".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no tables")

def rows(frame):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    mine = rows(contract.queries()[name](spark, str(TABLES)).toPandas())
    theirs = rows(con.execute(contract.oracle_sql()[name]).df())
    assert mine == theirs and mine[1]


def test_entry_and_registry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
