"""Resolution by tiers."""

from pyspark.sql import functions as F

from skarn.operators import structure


def test_only_candidates_of_the_best_tier_are_made(spark):
    calls = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, None, None)], "id int, near string, far string")
    near = spark.createDataFrame([("a", 10), ("a", 11), ("b", None)], "near string, target int")
    far = spark.createDataFrame([("x", 10), ("x", 12), ("z", 13)], "far string, target int")
    found = structure.resolve_by_priority(calls, [("near", near), ("far", far)], "id")
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 1, 10), (1, 1, 11), (2, 2, 10), (2, 2, 12), (3, None, None), (4, None, None)]
    last = structure.resolve_by_priority(calls.withColumn("all", F.lit(0)), [("near", near), ("all", spark.createDataFrame([(0, 9)], "all int, target int"))], "id")
    assert {tuple(r) for r in last.collect()} == {(1, 1, 10), (1, 1, 11), (2, 2, 9), (3, 2, 9), (4, 2, 9)}
