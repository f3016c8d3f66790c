import pytest

from lumenaudit.llm import queries

from ..oracle import check, connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert check(spark, connection(), queries.queries()[name], queries.oracle_sql()[name]) > 0


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11))
