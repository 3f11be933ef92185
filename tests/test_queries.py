"""Every registered query with a SQL counterpart gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tests.conftest import SMALL

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    same, note, _ = compare(entry.queries()[name](spark, SMALL), duck, ORACLES[name])
    assert same, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries())
