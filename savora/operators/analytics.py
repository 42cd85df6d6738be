"""Behaviour, admin and operations analytics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savora.functions.time import instant
from savora.params import Params


def spine(spark: SparkSession, last: datetime, days: int) -> DataFrame:
    """The UTC days up to and including the last one."""
    end = instant(last).cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))


def clamped(days: int, p: Params) -> int:
    return max(1, min(p.max_days, days))


def visitor() -> Column:
    """The session; an event without one is a visitor of its own."""
    return F.coalesce(F.nullif("session_key", F.lit("")), F.concat(F.lit("e#"), F.col("event_id").cast("string")))


def in_days(events: DataFrame, last: datetime, days: int) -> DataFrame:
    day = F.to_date("created_at")
    end = instant(last).cast("date")
    return events.withColumn("day", day).where((F.col("day") > F.date_sub(end, days)) & (F.col("day") <= end))


def rate(part: Column, whole: Column, n: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, n))


def daily_visitors(events: DataFrame, p: Params, last: datetime, days: int) -> DataFrame:
    """Every day of the window: distinct viewing visitors, distinct visitors who took something away, and their rate."""
    days = clamped(days, p)
    viewed, took = F.col("action").isin(*p.view_actions), F.col("action").isin(*p.takeaway_actions)
    counts = in_days(events, last, days).groupBy("day").agg(F.countDistinct(F.when(viewed, visitor())).alias("view_uv"), F.countDistinct(F.when(took, visitor())).alias("takeaway_uv"))
    out = spine(events.sparkSession, last, days).join(counts, "day", "left").fillna(0, ["view_uv", "takeaway_uv"])
    return out.withColumn("takeaway_rate", rate(F.col("takeaway_uv"), F.col("view_uv")))


def visitor_totals(events: DataFrame, p: Params, last: datetime, days: int) -> DataFrame:
    """Distinct visitors over all days together."""
    viewed, took = F.col("action").isin(*p.view_actions), F.col("action").isin(*p.takeaway_actions)
    kept = in_days(events, last, clamped(days, p))
    return kept.agg(F.countDistinct(F.when(viewed, visitor())).alias("view_uv"), F.countDistinct(F.when(took, visitor())).alias("takeaway_uv"))


def action_counts(events: DataFrame, p: Params, last: datetime, days: int) -> DataFrame:
    return in_days(events, last, clamped(days, p)).groupBy("action").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "action")


def overview(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def status_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def mention_ratios(mentions: DataFrame, p: Params) -> DataFrame:
    """Average confidence and coverage; three ways to miss an address, and ratios to four places (0 without rows)."""
    n = F.count(F.lit(1))
    share = lambda c: F.when(n > 0, F.round(F.count_if(c) / n, 4)).otherwise(0.0)
    no_text = F.coalesce(F.col("address_text"), F.lit("")) == ""
    no_area = F.coalesce(F.col("area"), F.lit("")) == ""
    return mentions.agg(
        n.alias("mentions"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), share(F.col("confidence") >= p.confidence_min).alias("confident_ratio"), share(no_text).alias("missing_address_text"),
        share(no_text & no_area).alias("missing_text_and_area"), share(F.col("shop_id").isNotNull() & ~(no_text & no_area)).alias("aligned_with_place"),
    )


def jobs_by_day(jobs: DataFrame, last: datetime, days: int) -> DataFrame:
    """Every day of the window with its finished jobs by status; the pivot's values are fixed, so no extra pass looks for them."""
    done = in_days(jobs, last, days).groupBy("day").pivot("status", ["success", "failed"]).agg(F.count(F.lit(1)))
    return spine(jobs.sparkSession, last, days).join(done, "day", "left").fillna(0, ["success", "failed"])


def jobs_summary(jobs: DataFrame, last: datetime, days: int) -> DataFrame:
    """Finished jobs in the rolling window, which may reach into a day that has no bucket."""
    since = instant(last) - F.expr(f"interval {int(days)} days")
    kept = jobs.where((F.col("created_at") >= since) & F.col("status").isin("success", "failed"))
    return kept.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"))


def sums_by_day(df: DataFrame, value: str, last: datetime, days: int) -> DataFrame:
    sums = in_days(df, last, days).groupBy("day").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).cast("long").alias("total"), F.count(F.lit(1)).alias("n"))
    return spine(df.sparkSession, last, days).join(sums, "day", "left").fillna(0, ["total", "n"])


def shops_by_city(cities: DataFrame, shops: DataFrame) -> DataFrame:
    """Every city, also those without shops, with active and other shops."""
    counts = shops.groupBy("city").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") != "active").alias("inactive"))
    return cities.join(counts, "city", "left").fillna(0, ["active", "inactive"])


def crawl_gauges(jobs: DataFrame) -> DataFrame:
    """From the latest crawl's nested statistics: success, refusals and breaker of every source.

    jobs: created_at, job_id, stats (map of source to struct<status, fetched, failed, code_403, code_429, breaker, duplicates>).
    """
    last = jobs.agg(F.max_by("stats", F.struct("created_at", "job_id")).alias("stats"))
    s = last.select(F.explode("stats").alias("source", "s")).select("source", "s.*")
    tried = F.col("fetched") + F.col("failed")
    return s.select(
        "source",
        F.when(tried > 0, F.round(F.col("fetched") / tried, 4)).otherwise(F.when(F.col("status").isin("ok", "partial"), 1.0).otherwise(0.0)).alias("success"),
        F.when(F.col("fetched") > 0, F.round(F.col("code_403") / F.col("fetched"), 4)).otherwise(0.0).alias("ratio_403"),
        F.when(F.col("fetched") > 0, F.round(F.col("code_429") / F.col("fetched"), 4)).otherwise(0.0).alias("ratio_429"),
        F.col("breaker").cast("int").alias("breaker"),
    )


def rolling(events: DataFrame, now: datetime, hours: int, value: str) -> DataFrame:
    """Rows and their value in the last hours, boundary included."""
    since = instant(now) - F.expr(f"interval {int(hours)} hours")
    return events.where((F.col("created_at") >= since) & (F.col("created_at") <= instant(now))).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2).alias("total"))


def latest_jobs(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(n)


def shops_with_counts(shops: DataFrame, mentions: DataFrame, aliases: DataFrame, like: str | None = None) -> DataFrame:
    """Admin list: children are counted before the join. As in the original, % and _ of the user's text are wildcards."""
    m = mentions.where("shop_id is not null").groupBy("shop_id").agg(F.count(F.lit(1)).alias("mention_count"))
    a = aliases.groupBy("shop_id").agg(F.count(F.lit(1)).alias("alias_count"))
    kept = shops.where(F.col("name").like(f"%{like}%")) if like else shops
    return kept.join(m, "shop_id", "left").join(a, "shop_id", "left").fillna(0, ["mention_count", "alias_count"])


def window_total(df: DataFrame) -> DataFrame:
    """df with the number of all its rows, for paged lists."""
    return df.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def review_queue(reviews: DataFrame, mentions: DataFrame, shops: DataFrame, n: int = 50) -> DataFrame:
    pending = reviews.where("status = 'pending'").join(mentions.select("mid", "shop_name", "city"), "mid", "left")
    return pending.join(shops.select(F.col("shop_id").alias("candidate_id"), F.col("name").alias("candidate")), "candidate_id", "left").orderBy("mid").limit(n)


def preference_weights(favourites: DataFrame, views: DataFrame, shops: DataFrame, by: str, k: int = 3) -> DataFrame:
    """user, the k values of ``by`` with the largest weight: favourites 2, each of the last 20 views 1; equals by first seen."""
    recent = Window.partitionBy("user_id").orderBy(F.col("event_id").desc())
    last = views.withColumn("_i", F.row_number().over(recent)).where("_i <= 20").select("user_id", "shop_id", F.lit(1).alias("w"), (F.col("_i") + 1_000_000).alias("seq"))
    liked = favourites.select("user_id", "shop_id", F.lit(2).alias("w"), F.row_number().over(Window.partitionBy("user_id").orderBy("shop_id")).alias("seq"))
    both = liked.unionByName(last).join(shops.select("shop_id", by), "shop_id").where(F.col(by).isNotNull())
    sums = both.groupBy("user_id", by).agg(F.sum("w").alias("weight"), F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("weight").desc(), "seq"))
    return sums.withColumn("pos", place).where(F.col("pos") <= k).select("user_id", by, "weight", "pos")


def rate_limited(events: DataFrame, key: str, minutes: int, most: int) -> DataFrame:
    """Sliding limit: rejected events don't count, so each key's events are folded in order (Python: a recurrence, not a window).

    A key's accepted events of the last minutes are all the fold keeps; groups stream through in Arrow batches sorted by time.
    """
    import pyarrow as pa

    schema = f"{key} string, event_id long, accepted boolean"
    span = minutes * 60_000_000

    def run(batches):
        current, kept = object(), []
        for batch in batches:
            keys, ids, times = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for k, t in zip(keys, times, strict=True):
                if k != current:
                    current, kept = k, []
                kept = [x for x in kept if x >= t - span]
                ok = len(kept) < most
                if ok:
                    kept.append(t)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(out, pa.bool_())], names=[key, "event_id", "accepted"])

    slim = events.select(F.col(key).cast("string").alias(key), "event_id", F.unix_micros("created_at").alias("t"))
    return slim.repartition(F.col(key)).sortWithinPartitions(key, "t", "event_id").mapInArrow(run, schema)
