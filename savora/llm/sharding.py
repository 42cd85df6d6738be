"""Sharding by global byte-size prefix sums, cut at equal targets.

The rows' global order is (hash of the text, id), so equal texts lie together. ``global_prefix``
gives each row the bytes before it; the order is cut where those pass equal shares of the total,
so shards are contiguous and near equal. A cut inside a small group of equal texts moves to the
group's nearer edge; a group too large for that (over ``snap`` of a shard and over the largest
document) is split, since no near-equal law could keep it whole.

Defined results: a null text has no bytes (size 1, CRC of nothing 0); a null id sorts first;
repeated rows take neighbouring slots; an empty table gives no rows; with fewer rows than shards
some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm.common import global_prefix, materialize, read_table

N_SHARDS = 16


def shard_by_bytes(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", snap: float = 0.02) -> DataFrame:
    """id, size, text_crc32, shard, slot (gapless from 0 in each shard), for every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text).alias("_crc"), F.xxhash64(text).alias("_group"))
    rows = materialize(global_prefix(slim, ["_group", "_id", "_size", "_crc"], {"_start": "_size"}, "shard-order"), "shard-prefix")
    total, largest = rows.agg(F.sum("_size"), F.max("_size")).first()
    cuts = [total * k // n_shards for k in range(1, n_shards)] if total else []
    cuts = _snapped(rows, cuts, max(snap * (total or 0) / n_shards, largest or 0))
    middle = F.col("_start") + F.col("_size") / 2
    shard = sum((F.when(middle >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    cut = rows.withColumn("_shard", shard)
    first = cut.groupBy("_shard").agg(F.min("row_index").alias("_first"))  # a row for each shard
    return cut.join(F.broadcast(first), "_shard").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), (F.col("row_index") - F.col("_first")).alias("slot")
    )


def _snapped(rows: DataFrame, cuts: list[int], limit: float) -> list[float]:
    """At most one group is open at each cut, so what comes to the driver is bounded by the number of shards."""
    if not cuts:
        return []
    at = F.array_min(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: (c >= F.col("_start")) & (c < F.col("_start") + F.col("_size"))))
    open_groups = rows.where(at.isNotNull()).select("_group").distinct()
    spans = rows.join(F.broadcast(open_groups), "_group").groupBy("_group").agg(F.min("_start").alias("a"), F.max(F.col("_start") + F.col("_size")).alias("b")).collect()
    out = []
    for c in cuts:
        a, b = next(((s["a"], s["b"]) for s in spans if s["a"] <= c < s["b"]), (c, c))
        out.append(float(c) if b - a > limit or a == b else float(a if c - a <= b - c else b))
    return out


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_by_bytes(read_table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
