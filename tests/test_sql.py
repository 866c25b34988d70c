"""Every registered query of the library against its SQL."""

import pytest

from rillstats.plans import catalogue
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, data, name):
    same(catalogue.QUERIES[name](spark, data), catalogue.ORACLE_SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
