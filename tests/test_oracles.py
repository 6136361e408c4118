"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from millrace import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def same(a, b):
    def plain(rows, columns):
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return sorted([tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in rows])

    assert sorted(a[1]) == sorted(b[1])
    assert plain(*a) == plain(*b)


@pytest.mark.parametrize("key", sorted(plans.QUERIES))
def test_query(spark, duck, key):
    df = plans.QUERIES[key](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    assert rows  # no query proves itself with empty tables on both sides
    if key in plans.ORACLES:
        got = duck.sql(plans.ORACLES[key])
        same((rows, df.columns), (got.fetchall(), got.columns))
