import pytest

from lamina.plans.registry import load
from tests.oracle import connect, spark_rows, sql_rows

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, con, name):
    got = spark_rows(QUERIES[name](spark, sf))
    if name in SQL:
        assert got == sql_rows(con, SQL[name])
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())
