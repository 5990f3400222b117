"""Every registered query against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from quadtide import workload

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't there")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return v if v is None or isinstance(v, (str, bool)) else str(v)


def test_every_query_has_sql():
    assert set(workload.QUERIES) == set(workload.ORACLES) and len(workload.QUERIES) > 50


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, tables, name):
    df = workload.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = tables.sql(workload.ORACLES[name])
    order = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", ["nquads_parse", "dictionary_roundtrip", "dictionary_extend"])
def test_every_quad_is_taken(spark, tables, name):
    cells = tables.sql("SELECT count(user_id) + count(event_type) + count(value) FROM events").fetchall()[0][0]
    assert workload.QUERIES[name](spark, DATA).count() == cells
