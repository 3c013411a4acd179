"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from strata.plans import lakes, relational, scenarios

SF = "/root/testdata/sf0.001"
ALL = lakes.queries() | relational.queries() | scenarios.queries()
ORACLE = lakes.oracle_sql() | relational.oracle_sql() | scenarios.oracle_sql()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def value(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield db
    db.close()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")
@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, oracle, name):
    got = ALL[name](spark, SF)
    want = oracle.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = {c: i for i, c in enumerate(want.columns)}
    a = sorted((tuple(value(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(value(r[place[c]]) for c in columns) for r in want.fetchall()), key=repr)
    assert a == b


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    assert set(ALL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
