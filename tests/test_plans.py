"""Plan guards over every registered query (sf0.001)."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("key", sorted(E.QUERIES))
def test_no_cross_join_in_plan(spark, key):
    df = E.queries()[key](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in FORBIDDEN:
        assert node not in plan, f"{key} plans a {node}"
    # each page is parsed at most once per plan branch set: never two parses stacked
    assert plan.count("ArrowEvalPython") <= 1, key
