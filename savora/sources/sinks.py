"""Writers: snapshots, sheets and metrics (upserts are in savora.operators.ingest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_items(items: DataFrame, path: str) -> None:
    """Ranking items, a folder for each city, so that reads of one city open no other files."""
    items.write.mode("append").partitionBy("city").parquet(path)


def review_sheet(items: DataFrame, mentions: DataFrame, top: int = 20) -> DataFrame:
    """Top items with the evidence of their first three mentions, ready for write.csv."""
    place = Window.partitionBy("shop_id").orderBy("mid")
    first = mentions.where("evidence is not null").withColumn("i", F.row_number().over(place)).where("i <= 3")
    texts = first.groupBy("shop_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.substring("evidence", 1, 60).alias("e")))), lambda x: x["e"]), " | ").alias("evidence"))
    return items.where(F.col("rank") <= top).join(texts, "shop_id", "left").select("city", "rank", "name", "evidence", F.lit("").alias("verdict"))


def exposition(metrics: DataFrame) -> DataFrame:
    """name, labels (map), value as lines of the text format."""
    pairs = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def expired(files: DataFrame, now, days: int = 90) -> DataFrame:
    """Snapshot files older than the keeping time."""
    return files.where(F.col("modified") < F.lit(now) - F.expr(f"interval {int(days)} days"))
