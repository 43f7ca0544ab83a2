"""Every relational and streaming query against DuckDB on the same tables."""

import os

import duckdb
import pytest

from lodestone.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(value):
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(map(plain, value))
    return None if value is None or value != value else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_duckdb(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    rows = sorted((tuple(plain(r[n]) for n in names) for r in found.collect()), key=repr)
    relation = duck.sql(ORACLE_SQL[name])
    at = [relation.columns.index(n) for n in names]
    assert sorted(relation.columns) == names
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
