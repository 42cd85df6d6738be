"""Merges resolved to their last targets; circles end at their least member."""

from savora.operators.resolve import merged_into


def test_chains_and_circles(spark):
    merges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 11), (5, 20), (30, 31), (31, 30), (40, 40), (50, 52), (50, 51)]
    got = {r.source: r.target for r in merged_into(spark, spark.createDataFrame(merges, "source long, target long")).collect()}
    assert got == {1: 4, 2: 4, 3: 4, 11: 10, 12: 10, 20: 10, 5: 10, 31: 30, 50: 51}
    assert merged_into(spark, spark.createDataFrame([], "source long, target long")).count() == 0


def test_long_chain(spark):
    rows = spark.range(1, 300).selectExpr("id AS source", "id + 1 AS target")
    assert {r.target for r in merged_into(spark, rows).collect()} == {300}
