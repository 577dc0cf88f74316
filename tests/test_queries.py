"""Every registered query against its SQL, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from tackline.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    want = rows_of(columns, cursor.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-5) for a, b in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
