"""Exact similarity join of names within blocks, by an inverted index of characters.

A name's characters, each with the number of its occurrence so far, are a set; the matching-block
ratio of two names is at most twice the common members over all characters. A pair that reaches the
ratio t shares t / (2 - t) of the members of either name at least, so it shares one of the rarest of
either: names are indexed under so many of their rarest members (a prefix) only, and meet under
common ones if their lengths allow it. Names one of which contains the other count 0.9 whatever
their lengths; they are found by joining names with the parts of names. Everything that meets is
scored, so the result is that of all pairs.

Members are counted by block, so common ones don't carry a prefix. Joins are on (block, member) and
(block, name), which Spark splits where one of them is hot; no task holds a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.text import name_similarity
from savora.sources.store import stored

CONTAINED = 0.9
BUNDLE = 256


def members(name: Column) -> Column:
    """Characters with the number of their occurrence: "aba" has a1, b1, a2."""
    letters = F.split(name, "")
    numbered = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    return F.filter(numbered, lambda m: F.char_length(m) > 1)


def _sides(left: DataFrame, right: DataFrame, block: list[str], name: str) -> DataFrame:
    """The distinct names of both sides: block, name, on_left, on_right. Empty names and null blocks are alike to nothing."""
    side = lambda df, k: df.select(*block, F.col(name).alias("name"), F.lit(k == 0).alias("on_left"), F.lit(k == 1).alias("on_right"))
    both = side(left, 0).unionByName(side(right, 1)).where(F.coalesce("name", F.lit("")) != "").dropna(subset=block)
    return both.groupBy(*block, "name").agg(F.bool_or("on_left").alias("on_left"), F.bool_or("on_right").alias("on_right"))


def candidates(names: DataFrame, block: list[str], least: float) -> DataFrame:
    """Pairs a (of the left side), b (of the right side) that may reach ``least``."""
    share = least / (2 - least)
    sized = names.withColumn("n", F.char_length("name")).withColumn("m", members(F.col("name")))
    each = sized.select(*block, "name", "n", "on_left", "on_right", F.explode("m").alias("member"))
    often = each.groupBy(*block, "member").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, [*block, "member"]).groupBy(*block, "name", "n", "on_left", "on_right").agg(F.sort_array(F.collect_list(F.struct("often", "member"))).alias("m"))
    kept = F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    prefix = ranked.select(*block, "name", "n", "on_left", "on_right", F.explode(F.slice("m", F.lit(1), F.greatest(kept, F.lit(1)).cast("int"))).alias("x")).select("*", F.col("x.member").alias("member")).drop("x")
    a = prefix.where("on_left").select(*block, "member", F.col("name").alias("a"), F.col("n").alias("na"))
    b = prefix.where("on_right").select(*block, "member", F.col("name").alias("b"), F.col("n").alias("nb"))
    near = 2 * F.least("na", "nb") >= F.lit(least) * (F.col("na") + F.col("nb")) - 1e-9
    met = a.join(b, [*block, "member"]).where(near).select(*block, "a", "b").distinct()
    common = lambda: F.size(F.array_intersect(members(F.col("a")), members(F.col("b"))))
    met = met.where(2 * common() >= F.lit(least) * (F.char_length("a") + F.char_length("b")) - 1e-9)
    if least <= CONTAINED:
        met = met.unionByName(_contained(names, block)).distinct()
    return met


def _contained(names: DataFrame, block: list[str]) -> DataFrame:
    """Pairs one of which is a part of the other; only parts as long as some name of the block are made."""
    lengths = names.groupBy(*block).agg(F.collect_set(F.char_length("name")).alias("lengths"))  # at most as many as a name's width
    n = F.char_length("name")
    parts = names.join(lengths, block).withColumn("n", F.explode("lengths")).where(F.col("n") <= n)
    parts = parts.select(*block, F.col("name").alias("whole"), F.col("on_left").alias("whole_left"), F.col("on_right").alias("whole_right"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("name") - F.col("n") + 1), lambda i: F.substring(F.col("name"), i, F.col("n"))))).alias("name"))
    met = parts.join(names, [*block, "name"])
    one = met.where("on_left and whole_right").select(*block, F.col("name").alias("a"), F.col("whole").alias("b"))
    return one.unionByName(met.where("whole_left and on_right").select(*block, F.col("whole").alias("a"), F.col("name").alias("b")))


def similar_names(left: DataFrame, right: DataFrame, block: list[str], name: str, least: float) -> DataFrame:
    """block, a, b, similarity: all pairs of distinct names of one block, from the left and from the right, of at least ``least`` (above 0)."""
    names = stored(_sides(left, right, block, name), "names")  # once; else what is derived from a name is pushed below the grouping, to every row
    pairs = candidates(names, block, least)
    return pairs.withColumn("similarity", name_similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= least)


def bundled(rows: DataFrame, key: list[str], value: Column, size: int = BUNDLE) -> DataFrame:
    """key and bundle: a group's values in arrays of about ``size``, as many as it takes. Null keys are left out."""
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64(value), F.ceil(F.col("_n") / size))
    return rows.join(n, key).groupBy(*key, part.alias("_part")).agg(F.collect_list(value).alias("bundle")).drop("_part")


def spread(rows: DataFrame) -> DataFrame:
    """Rows that become many, dealt to all cores: their number and size tell nothing of the work, so adaptive plans would join them into a few tasks."""
    spark = rows.sparkSession
    return rows.repartition(4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
