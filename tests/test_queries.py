import pytest
from tests.oracle import same

import __spark_entry__ as entry
from tarnlake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_duckdb(spark, data, name):
    same(catalogue.QUERIES[name](spark, data), catalogue.ORACLES[name], data)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark, data):
    plan = catalogue.QUERIES["filter_cmp_of_cmp"](spark, data)._jdf.queryExecution().toString()
    assert "Project" not in plan.split("== Physical Plan ==")[1].split("FileScan")[0] or "Filter" in plan
    plan = catalogue.QUERIES["filter_and_or"](spark, data)._jdf.queryExecution().toString()
    assert "LessThan(o_custkey,50)" in plan and "EqualTo(o_orderstatus,F)" in plan


def test_join_is_a_merge_join(spark, data):
    plan = catalogue.QUERIES["join_1n"](spark, data)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
