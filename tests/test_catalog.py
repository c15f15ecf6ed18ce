"""Every registered graph query against its SQL, run by DuckDB over the same files."""

import math
import os

import duckdb
import pytest

from graphloom import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def key(row):
    return tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(key(r[names.index(c)] for c in order) for r in found.fetchall())
    assert sorted(key(r[c] for c in order) for r in df.collect()) == want


def test_flagship(spark):
    df = catalog.flagship(spark, SF)
    assert df.columns == ["cust", "cname", "nname", "order", "status"]
    assert df.count() > 0
