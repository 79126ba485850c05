import pytest

from hearsay import event_queries, more_queries, queries, read_queries
from tests.check import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    assert_same(queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() >= 0


def test_registry():
    assert event_queries.query is more_queries.query is read_queries.query is queries.query and len(queries.QUERIES) > 90


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
