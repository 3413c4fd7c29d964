"""Plan shape of every registered plan: no pair products, no row-at-a-time
Python, filters pushed into the scan where the plan filters on stored
columns."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_pair_products(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"


@pytest.mark.parametrize("name,pushed", [
    ("event_day_query", "GreaterThanOrEqual(ts,"),
    ("segment_query", "EqualTo(c_nationkey,3)"),
    ("customers_within_region", "EqualTo(n_regionkey,2)"),
])
def test_filters_reach_scan(spark, name, pushed):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan


def test_projection_is_pruned(spark):
    plan = E.queries()["priority_frequency"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderpriority:string>" in plan
