import pytest

from quire.plans.queries import QUERIES, SQL

from .compare import same


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
