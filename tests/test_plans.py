"""Plans keep the shape they were written for."""

import os

import pytest

from reelgraph.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_top_n_limits_before_the_shuffle(spark):
    """In the plan of tables too large to broadcast; small ones meet without any shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(QUERIES["top_n_display"](spark, SF)).count("WindowGroupLimit") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["scene_changes"](spark, SF))
    assert "l_shipdate" not in text and "PushedFilters" in text
