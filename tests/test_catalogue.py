"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tallyweave.plans import catalogue, function_queries, graph_queries, oversight_queries  # noqa: F401  the others add to the first

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for x in TABLES:
        if os.path.exists(f"{small}/{x}.parquet"):
            c.sql(f"CREATE VIEW {x} AS SELECT * FROM '{small}/{x}.parquet'")
    return c


def norm(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_agrees(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    got = df.collect()
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = duck.sql(catalogue.ORACLES[name])
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(norm(r[c]) for c in columns) for r in got) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
