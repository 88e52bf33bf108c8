"""Every registered query against its comparison SQL on the smallest tables."""

import os

import pytest
from compare import connect, difference, spark_result, sql_result

from reelgraph.plans.oracle import SQL
from reelgraph.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = spark_result(QUERIES[name](spark, SF))
    assert got[1]
    if name in SQL:
        assert difference(got, sql_result(con, SQL[name])) is None
