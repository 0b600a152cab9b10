"""Every registered query against its SQL on the smallest tables."""

import pytest

import compare
from seekwell.checks import load

REGISTRY = load()


@pytest.fixture(scope="module")
def con(folder):
    return compare.database(folder)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, con, folder, name):
    ok, text = compare.compare(spark, con, folder, name, REGISTRY.QUERIES[name], REGISTRY.SQL.get(name))
    assert ok, text


def test_every_sql_has_a_query():
    assert set(REGISTRY.SQL) <= set(REGISTRY.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns and df.count() > 0
