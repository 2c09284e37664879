"""Keys of one side only: by one aggregate, nulls equal nothing."""

from foliant.operators import relational


def test_unmatched_keys_in_one_pass(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (None, "x"), (4, None)], "k int, s string")
    b = spark.createDataFrame([(1, "x"), (3, "x"), (3, "x"), (None, "x")], "k int, s string")
    got = relational.unmatched(a, b, ["k", "s"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, "x", "left_only"), (None, "x", "left_only"), (4, None, "left_only"), (3, "x", "right_only"), (None, "x", "right_only")], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
