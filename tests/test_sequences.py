"""Frames of ordered rows."""

from pyspark.sql import functions as F

from orrery.operators import sequences


def test_completion_fills_between_anchors_only(spark):
    rows = [("a", 1, 5), ("a", 2, None), ("a", 3, None), ("a", 4, 8), ("a", 5, None), ("a", 6, 11), ("a", 7, None), ("b", 1, None), ("b", 2, 3), ("b", 3, None), ("b", 4, 5)]
    x = sequences.complete(spark.createDataFrame(rows, "k string, p int, v int"), ["k"], "p", "v")
    assert {(r["k"], r["p"]): r["filled"] for r in x.collect()} == {("a", 1): 5, ("a", 2): 6, ("a", 3): 7, ("a", 4): 8, ("a", 5): None, ("a", 6): 11, ("a", 7): None, ("b", 1): None, ("b", 2): 3, ("b", 3): 4, ("b", 4): 5}


def test_completion_of_a_long_document_is_linear(spark):
    """No frame runs to the last row, which Spark reads anew for each row."""
    df = spark.range(0, 60_000, 1, 1).select(F.lit("d").alias("k"), "id", F.when((F.col("id") % 3 == 0), F.col("id") + 7).alias("v"))
    x = sequences.complete(df, ["k"], "id", "v")
    assert "unboundedfollowing" not in x._jdf.queryExecution().optimizedPlan().toString().lower().replace(" ", "")
    assert x.where("filled != id + 7 or filled is null").count() == 2  # after the last anchor
