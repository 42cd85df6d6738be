"""Lists that users keep (favourites, city packs, trips, posts): the outcome of every request, and what is on the lists in the end.

Requests have event_id, at, action and the list's keys. A key is on its list from its first ``add``
after the last ``remove``; repeated adds and removes change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moment() -> Column:
    """Orders requests: the time, then the id."""
    return F.struct("at", "event_id")


def outcomes(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Adds and removes with done: an add that created the entry, a remove that deleted one."""
    order = Window.partitionBy(*keys).orderBy("at", "event_id")
    before = F.coalesce(F.lag("action").over(order), F.lit("remove"))
    return requests.where(F.col("action").isin("add", "remove")).withColumn("done", F.col("action") != before)


def holdings(requests: DataFrame, keys: list[str]) -> DataFrame:
    """keys, since: what is on the lists after all requests."""
    gone = requests.groupBy(*keys).agg(F.max(F.when(F.col("action") == "remove", moment())).alias("gone"))
    adds = requests.where("action = 'add'").join(gone, keys).where(F.col("gone").isNull() | (moment() > F.col("gone")))
    return adds.groupBy(*keys).agg(F.min(moment()).alias("since")).select(*keys, F.col("since.at").alias("since"))


def trips(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Holdings with status (planned or visited) and visited_at, set once by the first visit after the trip was added."""
    held = holdings(requests, keys)
    visits = requests.where("action = 'visit'").join(held, keys).where(F.col("at") > F.col("since")).groupBy(*keys).agg(F.min("at").alias("visited_at"))
    return held.join(visits, keys, "left").withColumn("status", F.when(F.col("visited_at").isNotNull(), "visited").otherwise("planned"))


def with_shop_figures(entries: DataFrame, shops: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entries with the shop's name and city, its mentions, and the day the last of them came in (not the day it was published)."""
    figures = mentions.where("shop_id is not null").groupBy("shop_id").agg(F.count(F.lit(1)).alias("mention_count"), F.date_format(F.max("crawled_at"), "yyyy-MM-dd").alias("last_mentioned_at"))
    named = entries.join(shops.select("shop_id", "name", "city"), "shop_id")
    return named.join(figures, "shop_id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0)))


def newest(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n newest rows of each group."""
    order = Window.partitionBy(by).orderBy(F.col("at").desc(), F.col("event_id").desc())
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def approvals(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Reviews that move a post into the approved state (from any other); approving again counts no more."""
    return outcomes(reviews, keys).where("done and action = 'add'")


def recent(visits: DataFrame, key: str, value: str, n: int = 6) -> DataFrame:
    """Each key's last n distinct values, the latest first."""
    last = visits.groupBy(key, value).agg(F.max(moment()).alias("last"))
    order = Window.partitionBy(key).orderBy(F.col("last").desc(), F.col(value))
    top = last.withColumn("i", F.row_number().over(order)).where(F.col("i") <= n)
    return top.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", value))), lambda x: x[value]), ",").alias("recent"))
