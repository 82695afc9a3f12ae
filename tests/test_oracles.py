"""Every query with an SQL twin gives the same rows as DuckDB."""

import duckdb
import pytest

import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def canonical(value):
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, folder, duck, name):
    table = registry.QUERIES[name](spark, folder)
    columns = sorted(table.columns)
    ours = sorted(tuple(canonical(row[c]) for c in columns) for row in table.collect())
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    theirs = sorted(tuple(canonical(row[i]) for i in places) for row in result.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_every_query_is_a_function():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    flagship = entry.entry(spark)
    assert flagship.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
