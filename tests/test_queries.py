"""Every query with SQL equals DuckDB on the driver's tables."""

import os

import duckdb
import pytest

from tallyfold.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(registry.SQL[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(x) for x in cols]
    got = sorted((tuple(r[x] for x in cols) for r in df.collect()), key=key)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
