"""Connected components by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savora.llm.common import discard, materialize


def components(edges: DataFrame, tag: str) -> DataFrame:
    """edges: a, b (long, not null). Returns node, root, where root is the smallest node reachable; nodes without edges are absent.

    Every round links each node's larger neighbours to the smallest of its neighbourhood, then its
    smaller ones, and the distinct edges are written to the shared folder. The edges become stars
    around the least nodes in a logarithmic number of rounds; a hot node's edges are only ever
    summed up (a minimum) and joined back.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-edges")
    mark = _mark(now)
    for _ in range(100):
        large = _step(now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        after = materialize(_step(large, larger=False), f"{tag}-round")
        discard(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle in 100 rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Tells sets of edges apart: their number, and two sums of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(k), "a", "b").cast("decimal(20,0)")) for k in (1, 2)]).first())


def _step(pairs: DataFrame, larger: bool) -> DataFrame:
    """Links neighbours of a node to the least of its neighbourhood: the larger ones, or (of edges that point down) the node and its smaller ones."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = pairs.join(least, "a")
    if larger:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
