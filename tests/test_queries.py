import pytest

from lumenaudit.plans import catalog, queries  # noqa: F401

from .oracle import check, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert check(spark, con, catalog.QUERIES[name], catalog.ORACLES[name]) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= __spark_entry__.oracle_sql().keys() >= catalog.QUERIES.keys()
    assert __spark_entry__.entry(spark).count() > 0
