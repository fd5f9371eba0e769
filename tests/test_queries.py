"""Every registered query runs, and gives the rows of its SQL where it has one."""

from __future__ import annotations

import pytest

from dossierlake.plans.registry import QUERIES, SQL
from tests.oracle import assert_same, connection


@pytest.fixture(scope="module")
def duck(tiny):
    return connection(tiny)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, duck, name):
    found = QUERIES[name](spark, tiny).toPandas()
    assert len(found.columns) == len(set(found.columns))
    if name in SQL:
        assert_same(found, duck.sql(SQL[name]).df())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 14
