"""Every registered query against DuckDB on the driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from gridvalue import registry
from oracles import registry as oracle_registry

TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem"]
QUERIES, ORACLES = dict(registry.QUERIES), oracle_registry.oracle_sql()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert kinds == {f.name: TYPES[f.dataType.simpleString()] for f in df.schema}
    names = sorted(df.columns)
    at = [list(kinds).index(n) for n in names]
    expected = sorted(tuple(shown(r[i]) for i in at) for r in cursor.fetchall())
    got = sorted(tuple(shown(x) for x in r) for r in df.select(*names).collect())
    assert got == expected and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
