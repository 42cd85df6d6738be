"""Structured Streaming jobs: ingest, daily buckets, gauges, and liveness (state machines are in savora.streaming.states).

Each takes a streaming DataFrame and returns one, or the rows of a batch; with the same rows,
batch and stream give the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from savora.functions.text import content_hash
from savora.params import Params


def first_contents(raw: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (source, text) once within the watermark; rows without a time are given that of their crawl."""
    at = raw.withColumn("event_at", F.coalesce("published_at", "crawled_at")).withWatermark("event_at", delay)
    return at.withColumn("content_hash", content_hash(F.col("raw_text"))).dropDuplicatesWithinWatermark(["source", "content_hash"])


def daily_actions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events by day and action, for append or update mode."""
    w = events.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day").alias("w"), "action")
    return w.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("session_key").alias("visitors")).select(F.col("w.start").cast("date").alias("day"), "action", "n", "visitors")


def sliding_counts(events: DataFrame, span: str = "24 hours", step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    w = events.withWatermark("created_at", delay).groupBy(F.window("created_at", span, step).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.end").alias("upto"), "n", "total")


def liveness(history: DataFrame, p: Params) -> DataFrame:
    """The state of each key after every batch (key, at in micros, seq, kind: hit, miss or evidence)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        misses, now = state.get if state.exists else (0, "active")
        for kind in pd.concat(list(batches)).sort_values(["at", "seq"])["kind"]:
            if kind == "miss":
                misses += 1
                if now != "closed":
                    now = "closed" if misses >= p.closed_misses else "suspect" if misses >= p.suspect_misses else now
            else:
                misses = 0
                now = now if now == "closed" and kind == "hit" else "active"
        state.update((misses, now))
        yield pd.DataFrame({"key": [key[0]], "miss_count": [misses], "liveness": [now]})

    return history.groupBy("key").applyInPandasWithState(fold, "key long, miss_count long, liveness string", "misses long, now string", "update", GroupStateTimeout.NoTimeout)
