"""Whether a shop still exists: evidence, misses, and the states that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from savora.functions.time import instant
from savora.params import Params


def first_last_mention(mentions: DataFrame) -> DataFrame:
    """First mention by publication, else by crawl, and whether it is confident; last by either."""
    found = mentions.where("shop_id is not null").groupBy("shop_id").agg(F.min("published_at").alias("_pub"), F.min("crawled_at").alias("_crawl"), F.max(F.coalesce("published_at", "crawled_at")).alias("last_mentioned_at"))
    return found.select("shop_id", F.coalesce("_pub", "_crawl").alias("first_mentioned_at"), F.col("_pub").isNotNull().alias("confident"), "last_mentioned_at")


def last_checkin(posts: DataFrame) -> DataFrame:
    return posts.where("status = 'approved'").groupBy("shop_id").agg(F.max("created_at").alias("last_checkin_at"))


def mark_seen(shops: DataFrame, seen: DataFrame) -> DataFrame:
    """seen: shop_id, seen_at. A sighting resets the misses and clears suspicion; a closed shop stays closed."""
    met = shops.join(seen.groupBy("shop_id").agg(F.max("seen_at").alias("_seen")), "shop_id", "left")
    hit = F.col("_seen").isNotNull()
    out = met.withColumn("miss_count", F.when(hit, 0).otherwise(F.col("miss_count"))).withColumn("last_seen_at", F.coalesce("_seen", "last_seen_at"))
    return out.withColumn("liveness", F.when(hit & (F.col("liveness") == "suspect"), "active").otherwise(F.col("liveness"))).drop("_seen")


def mark_misses(shops: DataFrame, rounds: DataFrame) -> DataFrame:
    """rounds: city, before, records. Only a round that returned records counts, for known, open shops seen before it."""
    met = shops.join(rounds.where("records > 0").select("city", "before"), "city", "left")
    missed = F.coalesce(F.col("poi_id").isNotNull() & (F.col("liveness") != "closed") & (F.col("last_seen_at") < F.col("before")), F.lit(False))
    return met.withColumn("miss_count", F.col("miss_count") + F.when(missed, 1).otherwise(0)).drop("before")


def apply_evidence(shops: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence: shop_id, created_at of approved posts. Revives suspect and closed shops; relocated ones stay."""
    met = shops.join(evidence.groupBy("shop_id").agg(F.max("created_at").alias("_e")), "shop_id", "left")
    hit = F.col("_e").isNotNull()
    revived = hit & F.col("liveness").isin("suspect", "closed")
    out = met.withColumn("last_checkin_at", F.greatest("_e", "last_checkin_at")).withColumn("miss_count", F.when(hit, 0).otherwise(F.col("miss_count")))
    out = out.withColumn("closed_at", F.when(~revived, F.col("closed_at")))
    return out.withColumn("liveness", F.when(revived, "active").otherwise(F.col("liveness"))).drop("_e")


def evaluate(shops: DataFrame, p: Params) -> DataFrame:
    """Misses to states, in one pass: both updates are disjoint."""
    suspect = max(1, p.suspect_misses)
    closed = max(suspect, 1, p.closed_misses)
    state, miss = F.col("liveness"), F.col("miss_count")
    closing = state.isin("active", "suspect") & (miss >= closed)
    out = shops.withColumn("closed_at", F.when(closing, instant(p.now)).otherwise(F.col("closed_at")))
    return out.withColumn("liveness", F.when(closing, "closed").when((state == "active") & (miss >= suspect), "suspect").otherwise(state))


def replay(history: DataFrame, p: Params) -> DataFrame:
    """The state after a whole history (key, at, seq, kind: hit, miss or evidence), by gaps and islands.

    Misses count since the last hit or evidence. A shop closes when they reach the limit; only
    evidence reopens it, so misses and hits after the closing change nothing but the count.
    """
    order = Window.partitionBy("key").orderBy("at", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    resets = F.sum(F.when(F.col("kind") != "miss", 1).otherwise(0)).over(upto)
    life = F.sum(F.when(F.col("kind") == "evidence", 1).otherwise(0)).over(upto)
    run = Window.partitionBy("key", "_run").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = history.withColumn("_run", resets).withColumn("_life", life).withColumn("_misses", F.sum(F.when(F.col("kind") == "miss", 1).otherwise(0)).over(run))
    lives = marked.groupBy("key", "_life").agg(F.max("_misses").alias("most"), F.max_by("_misses", F.struct("at", "seq")).alias("now"))
    last = lives.groupBy("key").agg(F.max_by(F.struct("most", "now"), "_life").alias("x")).select("key", "x.most", "x.now")
    state = F.when(F.col("most") >= p.closed_misses, "closed").when(F.col("now") >= p.suspect_misses, "suspect").otherwise("active")
    return last.select("key", F.col("now").alias("miss_count"), state.alias("liveness"))


def miss_distribution(shops: DataFrame) -> DataFrame:
    """Counts by misses (closed shops only in the states), a row for each city."""
    open_ = F.col("liveness") != "closed"
    m = F.col("miss_count")
    count = lambda c: F.count_if(open_ & c)
    return shops.groupBy("city").agg(
        F.count(F.lit(1)).alias("base"), count(F.col("last_seen_at").isNotNull()).alias("seen"), count(F.col("last_seen_at").isNull()).alias("never"), count(m == 0).alias("miss_0"), count((m >= 1) & (m <= 4)).alias("miss_1_4"),
        count((m >= 5) & (m <= 9)).alias("miss_5_9"), count(m >= 10).alias("miss_10"), F.max(F.when(open_, m)).alias("most"), *[F.count_if(F.col("liveness") == s).alias(f"is_{s}") for s in ("active", "suspect", "closed", "relocated")],
    )


def threshold_simulation(shops: DataFrame, limits: tuple[tuple[int, int], ...] = ((5, 10), (7, 14), (10, 20))) -> DataFrame:
    """How many shops each pair of limits would mark; all pairs from one pass over the shops."""
    m = F.col("miss_count")
    cols = [F.struct(F.lit(s).alias("suspect_at"), F.lit(c).alias("closed_at"), F.count_if((m >= s) & (m < c)).alias("suspects"), F.count_if(m >= c).alias("closings")) for s, c in limits]
    one = shops.where("liveness <> 'closed'").agg(*[c.alias(f"_{k}") for k, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[F.col(f"_{k}") for k in range(len(cols))])).alias("x")).select("x.*")
