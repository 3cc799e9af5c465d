"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from emberlog.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in found.collect())
    result = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(dict(zip(names, x))[c]) for c in columns) for x in result.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(registry.oracle_sql()) <= set(registry.queries()) <= set(entry.queries())
