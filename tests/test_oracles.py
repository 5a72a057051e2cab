import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 200


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, sf, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], sf) is None
