"""Recommendations from ranking items: by taste, else what is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_items(items: DataFrame, k: int) -> DataFrame:
    """The first k items of each city, and of those the ones with mentions: the cut comes before the filter."""
    return items.where((F.col("rank") <= k) & (F.col("mention_count") > 0))


def by_taste(items: DataFrame, cities: DataFrame, cuisines: DataFrame, seen: DataFrame, limit: int = 6, depth: int = 12) -> DataFrame:
    """user_id, shop_id, pos. cities and cuisines: user_id, name, pos; seen: user_id, shop_id.

    A user's cities in order; within a city its preferred cuisines in order, then the rest of its
    items. Cities are added until twice the limit is reached; what was seen goes after that.
    """
    limit = max(1, min(10, limit))
    met = cities.select("user_id", "city", F.col("pos").alias("_city")).join(top_items(items, depth), "city")
    met = met.join(cuisines.select("user_id", "cuisine", F.col("pos").alias("_cuisine")), ["user_id", "cuisine"], "left").withColumn("_cuisine", F.coalesce("_cuisine", F.lit(99)))
    order = Window.partitionBy("user_id").orderBy("_city", "_cuisine", "rank")
    upto = Window.partitionBy("user_id").orderBy("_city").rangeBetween(Window.unboundedPreceding, -1)
    kept = met.withColumn("_before", F.count(F.lit(1)).over(upto)).where(F.col("_before") < 2 * limit)
    left = kept.join(seen, ["user_id", "shop_id"], "left_anti")
    return left.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("user_id", "shop_id", "city", "cuisine", "pos")


def hot(items: DataFrame, seen: DataFrame | None = None, limit: int = 6, depth: int = 3) -> DataFrame:
    """The first items of each city, city by city in name order."""
    limit = max(1, min(10, limit))
    left = top_items(items, depth)
    if seen is not None:
        left = left.join(seen.select("shop_id"), "shop_id", "left_anti")
    return left.orderBy("city", "rank").limit(limit).select("city", "rank", "shop_id", "name")
