"""Ranking snapshots, their enrichment, and reads of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from savora.functions.text import clip, maturity
from savora.functions.time import instant, rnd
from savora.operators.scoring import shop_scores
from savora.params import Params


def rank_items(scores: DataFrame, p: Params) -> DataFrame:
    """The top of every city by final score and name, with a display score from 1.0 to 4.9 by place."""
    aligned = scores.where(F.col("shop_id").isNotNull() & ~F.col("excluded"))
    place = Window.partitionBy("city").orderBy(F.col("final").desc(), F.col("name").asc(), F.col("shop_id").asc())
    top = aligned.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= p.top_n)
    n = F.count(F.lit(1)).over(Window.partitionBy("city"))
    share = F.when(n > 1, (n - F.col("rank")) / (n - 1)).otherwise(1.0)
    return top.withColumn("display_score", rnd(1 + 3.9 * share, 1))


def build_rank(mentions: DataFrame, shops: DataFrame, p: Params) -> DataFrame:
    return rank_items(shop_scores(mentions, shops, p), p)


def top_words(mentions: DataFrame, column: str, k: int = 5) -> DataFrame:
    """shop_id and its k most frequent words of an array column; of equals, those met first."""
    words = mentions.where("shop_id is not null").select("shop_id", "mid", F.posexplode(column).alias("seen_at", "word"))
    placed = words.groupBy("shop_id", "word", "seen_at").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("mid"))  # numbers only: counted without a sort
    counted = placed.repartition("shop_id").groupBy("shop_id", "word").agg(F.sum("n").alias("n"), F.min(F.struct("mid", "seen_at")).alias("first"))
    order = Window.partitionBy("shop_id").orderBy(F.col("n").desc(), F.col("first").asc())
    best = counted.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k)
    return best.groupBy("shop_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias(column))


def first_sources(mentions: DataFrame, n: int = 3, excerpt: int = 120) -> DataFrame:
    """A row for each shop's first n contents in the order of mentions."""
    first = Window.partitionBy("shop_id", "content_id").orderBy("mid")
    once = mentions.where("shop_id is not null").withColumn("_again", F.lag(F.lit(True)).over(first)).where("_again is null")  # a row number would be limited, and sorted, before the shuffle too
    place = Window.partitionBy("shop_id").orderBy("mid")
    ranked = once.withColumn("i", F.row_number().over(place)).where(F.col("i") <= n)
    return ranked.select("shop_id", "i", "content_id", "platform", "source_url", clip(F.col("evidence"), excerpt).alias("excerpt"), "published_at")


def enriched(items: DataFrame, mentions: DataFrame) -> DataFrame:
    """Items with words, sources, last mention and address; over all of a shop's mentions, whatever the city."""
    last = mentions.where("shop_id is not null").groupBy("shop_id").agg(F.date_format(F.max("seen_at"), "yyyy-MM-dd").alias("last_mentioned_at"), F.min_by("address_text", "mid").alias("_first_address"))
    sources = first_sources(mentions).groupBy("shop_id").agg(F.sort_array(F.collect_list(F.struct("i", "platform", "source_url", "excerpt", "published_at"))).alias("sources"))
    out = items
    for part in (top_words(mentions, "praise"), top_words(mentions, "complaints"), sources, last):
        out = out.join(part, "shop_id", "left")
    return out.withColumn("address", F.coalesce(F.nullif("address", F.lit("")), "_first_address")).drop("_first_address")


def latest_by_time(snapshots: DataFrame) -> DataFrame:
    """Each city's snapshot for reading ranks: by generation time, then id."""
    return snapshots.groupBy("city").agg(F.max(F.struct("generated_at", "snapshot_id")).alias("x")).select("city", "x.snapshot_id", "x.generated_at")


def latest_by_id(snapshots: DataFrame) -> DataFrame:
    """Each city's snapshot for city lists, recommendations and reports: by id alone."""
    return snapshots.groupBy("city").agg(F.max("snapshot_id").alias("snapshot_id"))


def filtered(items: DataFrame, cuisine: str | None = None, area: str | None = None, price_min: float | None = None, price_max: float | None = None) -> DataFrame:
    out = items
    if cuisine:
        out = out.where(F.contains(F.col("cuisine"), F.lit(cuisine)))
    if area:
        out = out.where(F.col("area") == area)
    if price_min is not None:
        out = out.where(F.col("avg_price") >= price_min)
    if price_max is not None:
        out = out.where(F.col("avg_price") <= price_max)
    return out


def within_days(items: DataFrame, shops: DataFrame, days: int, p: Params) -> DataFrame:
    """Items whose active shop was mentioned in the last days before the snapshot (boundary included), ranked anew."""
    since = instant(p.now) - F.expr(f"interval {int(days)} days")
    eligible = shops.where((F.col("status") == "active") & (F.col("last_mentioned_at") >= since)).select("shop_id")
    kept = items.join(eligible, "shop_id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("city").orderBy("rank")))


def page(items: DataFrame, number: int, size: int) -> DataFrame:
    """Rows of one page of every city's filtered list, in rank order."""
    size, number = max(1, min(100, size)), max(1, number)
    at = F.row_number().over(Window.partitionBy("city").orderBy("rank"))
    return items.withColumn("_at", at).where((F.col("_at") > (number - 1) * size) & (F.col("_at") <= number * size)).drop("_at")


def envelopes(items: DataFrame, shown: DataFrame) -> DataFrame:
    """City, rows after filters, rows before them, and the tier that follows from the latter."""
    every = items.groupBy("city").agg(F.count(F.lit(1)).alias("city_rank_count"))
    left = shown.groupBy("city").agg(F.count(F.lit(1)).alias("total"))
    return every.join(left, "city", "left").select("city", F.coalesce("total", F.lit(0)).alias("total"), "city_rank_count", maturity(F.col("city_rank_count")).alias("tier"))


def city_list(cities: DataFrame, hints: DataFrame, shops: DataFrame, items: DataFrame) -> DataFrame:
    """Known cities and hints in one list with the counts of shops, contents and ranked shops."""
    names = cities.select("city").union(hints.where("city is not null").select("city")).distinct()
    counts = [
        shops.groupBy("city").agg(F.count(F.lit(1)).alias("restaurant_count")),
        hints.groupBy("city").agg(F.count(F.lit(1)).alias("content_count")),
        items.groupBy("city").agg(F.count(F.lit(1)).alias("rank_count")),
    ]
    out = names
    for c in counts:
        out = out.join(c, "city", "left")
    out = out.fillna(0, ["restaurant_count", "content_count", "rank_count"])
    return out.withColumn("has_rank", F.col("rank_count") > 0).withColumn("tier", maturity(F.col("rank_count")))


def city_order(cities: DataFrame, items: DataFrame, shops: DataFrame) -> DataFrame:
    """Cities in the order of the start page: with a ranking first, then by ranked shops, shops and name. One row a city."""
    ranked = items.groupBy("city").agg(F.count(F.lit(1)).alias("rank_count"))
    counted = cities.join(ranked, "city", "left").join(shops.groupBy("city").agg(F.count(F.lit(1)).alias("shop_count")), "city", "left")
    filled = counted.select("city", F.coalesce("rank_count", F.lit(0)).alias("rank_count"), F.coalesce("shop_count", F.lit(0)).alias("shop_count")).withColumn("has_rank", F.col("rank_count") > 0)
    return filled.withColumn("place", F.row_number().over(Window.orderBy(F.col("has_rank").desc(), F.col("rank_count").desc(), F.col("shop_count").desc(), "city")))
