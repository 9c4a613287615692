"""Every query with SQL against DuckDB, and the driver's entry points."""

import pytest

import __spark_entry__ as entry
from dependra.plans import catalog


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_against_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
