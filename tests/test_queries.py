"""Every engine query against its DuckDB SQL."""

import pytest

import __spark_entry__ as entry
from larkspur.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, compare, name):
    compare(QUERIES[name](spark, small), ORACLE_SQL[name], small)


def test_entry(spark, small):
    assert entry.entry(spark).count() == 10
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
