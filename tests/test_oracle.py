"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLE[name]) is None


def test_sql_is_registered():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_one_row(spark):
    assert entry.entry(spark).count() == 1
