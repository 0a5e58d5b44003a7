"""Every query with SQL returns what DuckDB returns for it on the smallest tables."""

import pytest

from graphloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches(name, same):
    same(QUERIES[name], SQL[name])


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["wanted", "target_id", "id", "name", "file_id"]
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
