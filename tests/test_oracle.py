"""Every registered query against its SQL on the shared tables."""

import duckdb
import pytest

from inkveil.plans.oracle import statements
from inkveil.plans.workload import registered

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
QUERIES = registered()
SQL = statements()


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def ordered(rows, names):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(row[i] for i in at) for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_points():
    import __spark_entry__ as contract

    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(name, spark, sf_dir, duck):
    result = QUERIES[name](spark, sf_dir)
    expected = duck.sql(SQL[name])
    assert sorted(result.columns) == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    for column, kind in result.dtypes:
        assert types[column] == KINDS.get(kind, types[column]), column
    got = ordered(result.collect(), result.columns)
    want = ordered(expected.fetchall(), expected.columns)
    assert len(got) == len(want)
    assert got == want
