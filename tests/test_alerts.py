"""Counters that start again, quantiles of histograms, conditions that hold."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from savora.operators import alerts

START = datetime(2026, 1, 1)


def samples(spark, *values, series="s"):
    return spark.createDataFrame([(series, START + timedelta(minutes=m), float(v)) for m, v in values], "series string, at timestamp, value double")


def test_increases(spark):
    rows = alerts.increases(samples(spark, (0, 5), (1, 7), (2, 1), (3, 4), (10, 4), (11, 6)), ["series"], 3).orderBy("at")
    assert [r.increase for r in rows.collect()] == [0, 2, 3, 6, 0, 2]


@pytest.mark.parametrize(("q", "want"), [(0.0, 0.0), (0.25, 0.5), (0.5, 1.0), (0.75, 2.0), (0.95, 2.0)])
def test_quantile(spark, q, want):
    rows = spark.createDataFrame([("s", 1.0, 2), ("s", 2.0, 3), ("s", float("inf"), 4), ("none", 1.0, 0), ("none", float("inf"), 0)], "series string, le double, n long")
    got = {r.series: r.quantile for r in alerts.quantile(rows, ["series"], q).collect()}
    assert got["none"] is None and got["s"] == pytest.approx(want)


def test_held(spark):
    rows = alerts.held(samples(spark, (0, 1), (5, 9), (10, 9), (15, 9), (16, 1), (17, 9), (30, 9)), ["series"], F.col("value") > 5, 10).orderBy("at")
    assert [r.state for r in rows.collect()] == ["inactive", "pending", "pending", "firing", "inactive", "pending", "firing"]
