"""Every registered query against its SQL twin on DuckDB, over the smallest tables."""

import duckdb
import numpy as np
import pytest

from strataloom import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    twin = duck.sql(registry.ORACLES[name])
    assert sorted(twin.columns) == names
    at = [twin.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in twin.fetchall()), key=repr)


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 200
