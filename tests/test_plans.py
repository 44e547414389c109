"""No registered query plans a nested-loop join or a Cartesian product."""

from conftest import SF_SMALL


def test_no_pairwise_joins_in_any_query(spark):
    import __spark_entry__ as E
    bad = []
    for name, build in sorted(E.queries().items()):
        plan = build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        if "NestedLoopJoin" in plan or "CartesianProduct" in plan:
            bad.append(name)
    assert bad == []
