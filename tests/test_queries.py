"""Registered queries of the graph operators against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from weftgraph.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_like_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = tables.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted(tuple(shown(r[c]) for c in order) for r in got.collect()) == sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in want.fetchall())
