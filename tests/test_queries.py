"""Every query of the core against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = sorted(n for n in entry.CATALOGUE)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return round(float(v), 4) if type(v).__name__ == "Decimal" else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        result = db.sql(sql)
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        assert ordered(tuple(plain(x[i]) for i in at) for x in result.fetchall()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
