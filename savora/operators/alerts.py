"""Alert rules over samples: increases of counters that start again, quantiles from histogram buckets, conditions that have held for a time.

Samples come as rows (series columns, at, value). A sample counts for its own instant; windows reach
back from it, the boundary excluded, and nothing is extrapolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000


def increases(samples: DataFrame, series: list[str], minutes: int) -> DataFrame:
    """Adds increase: what the counter has grown by within the last minutes. A value below the one before means that it started from 0 again."""
    order = Window.partitionBy(*series).orderBy("at")
    before = F.lag("value").over(order)
    step = F.when(before.isNull(), 0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    span = Window.partitionBy(*series).orderBy(F.unix_micros("at")).rangeBetween(-minutes * MINUTE + 1, 0)
    return samples.withColumn("_step", step).withColumn("increase", F.sum("_step").over(span)).drop("_step")


def quantile(buckets: DataFrame, series: list[str], q: float) -> DataFrame:
    """series, quantile: buckets (series, le, n cumulative; the last le is infinity) interpolated within the bucket where the rank falls.

    A rank in the last bucket gives the highest finite bound, one in a first bucket with a bound above 0 starts at 0; null without observations.
    """
    order = Window.partitionBy(*series).orderBy("le")
    every = Window.partitionBy(*series)
    placed = buckets.select("*", F.lag("le").over(order).alias("_low"), F.coalesce(F.lag("n").over(order), F.lit(0)).alias("_under"), F.max("n").over(every).alias("_all"))
    rank = F.lit(q) * F.col("_all")
    low = F.coalesce("_low", F.least(F.lit(0.0), F.col("le")))
    inside = F.when(F.col("le") == F.lit(float("inf")), F.col("_low")).otherwise(low + (F.col("le") - low) * F.try_divide(rank - F.col("_under"), F.col("n") - F.col("_under")))
    hit = placed.where((F.col("_all") > 0) & (F.col("n") >= rank)).groupBy(*series).agg(F.min_by(inside, "le").alias("quantile"))
    return buckets.select(*series).distinct().join(hit, series, "left")


def held(samples: DataFrame, series: list[str], broken: Column, minutes: int) -> DataFrame:
    """Adds state: inactive, pending, or firing once the condition has been true in all samples over the minutes."""
    order = Window.partitionBy(*series).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = samples.withColumn("_on", F.coalesce(broken, F.lit(False)))
    marked = marked.withColumn("_island", F.count(F.when(~F.col("_on"), 1)).over(upto))
    since = F.min(F.when(F.col("_on"), F.col("at"))).over(Window.partitionBy(*series, "_island").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    long = F.unix_micros("at") - F.unix_micros(since) >= minutes * MINUTE
    return marked.withColumn("state", F.when(~F.col("_on"), "inactive").when(long, "firing").otherwise("pending")).drop("_on", "_island")
