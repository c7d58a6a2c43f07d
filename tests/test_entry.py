"""The driver's contract, and the catalogue against another engine."""

import math
import os

import pytest

import __spark_entry__ as entry
from veldt.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.SQL) == set(catalogue.QUERIES)
    if os.path.isdir(SF):
        assert entry.entry(spark).columns == ["c_custkey", "c_name", "o_orderkey", "o_totalprice"]


def _plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    theirs = con.execute(catalogue.SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(df.columns)
    if len(set(columns)) == len(columns):
        df = df.select(*columns)
    ours = sorted(repr(tuple(map(_plain, r))) for r in df.collect())
    assert ours == sorted(repr(tuple(map(_plain, r))) for r in theirs.fetchall())
