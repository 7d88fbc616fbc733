"""Each statement gives the same rows in Spark and in DuckDB."""

import duckdb
import pytest

from inkwell.plans import registry
from inkwell.plans.dialect import Dialect

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    other = duck.sql(registry.SQL[name])
    assert sorted(other.columns) == columns
    place = [other.columns.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[k]) for k in place) for r in other.fetchall()), key=repr)


def test_without_sql(spark):
    for name in registry.QUERIES.keys() - registry.SQL.keys():
        assert registry.QUERIES[name](spark, SF).count() > 0, name


def test_dialect_names_tables():
    assert Dialect().table("orders") == "orders"
