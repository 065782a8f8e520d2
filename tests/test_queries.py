"""Every core query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}") + 0.0
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = db.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
