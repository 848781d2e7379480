import pytest

from tarn.plans import evaluation_queries as E


@pytest.mark.parametrize("name", ["kappa_bootstrap", "kappa_bootstrap_by_kind"])
def test_picks_meet_no_join_on_their_kind(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables of any size
    try:
        plan = E.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan
