"""Every query that has SQL, compared with it on the driver's smallest tables; skipped where these are absent."""

import glob
import os

import pytest

from factloom.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    left = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    right = sorted(repr(tuple(plain(r[want.columns.index(c)]) for c in columns)) for r in want.fetchall())
    assert left == right


def test_entry_has_the_core_queries():
    import __spark_entry__ as entry

    assert registry.QUERIES.items() <= entry.queries().items() and registry.ORACLES.items() <= entry.oracle_sql().items()
