"""Every named query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, folder, name):
    assert compare(spark, con, folder, name) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["score", "score_std"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
