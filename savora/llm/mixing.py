"""Mixing sources to target weights by Pareto order sampling.

On the average, the documents of a source should appear target / source_size times. The whole part
of that is given to each of its documents (certain copies). The rest f is the source's mean
inclusion probability. A document's own inclusion odds are the source's odds f / (1 - f) times its
weight: a column given by the caller, or size / (size + ``HALF``), so that fragments of a few words
are rarely drawn. Each document draws a uniform u from a digest of its id, and documents are ranked
by random odds divided by inclusion odds, (u / (1 - u)) / (weight * f / (1 - f)). The sample is of a
fixed size in words: the ranking is taken while it fits what is left of the target, and the document
that comes nearest to the words still missing is added if that brings the source closer to its target.

Prefix sums over a source are global prefix sums over (source, rank), so that a source with a
third of all rows is spread over many tasks. The draw depends on seed and id only: reruns agree.

Defined results: a null or empty text has size 0 and takes nothing away; a null source is a
source of its own, after all others; sources without words get the target 0; repeated ids draw
alike and tie, broken by size; weights that are null or not above 0 are never drawn (whole copies
stay); very long texts count whole; an empty table gives no rows; further columns of any name are
left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savora.llm.common import WORD, global_prefix, located, materialize, read_table

WEIGHTS = (5, 2, 1)
MOST = 3
HALF = 100


def uniform(seed: str, key: Column) -> Column:
    """In (0, 1), from 52 bits of a digest."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / F.lit(float(16**13))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: _source, _words. Adds _weight, _target.

    Each source's target is min(most * size, level * weight), with the one level at which they
    add up to all words: resharing the excess by weight ends there. Sorted by size / weight, the
    capped sources come first, and the level follows from prefix sums of integers. There is a row
    for each source, no more.
    """
    place = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("_weight", weight.cast("long"))
    tight = Window.orderBy((F.col("_words") / F.col("_weight")).asc(), F.col("_source").asc_nulls_first())
    capped, everything = tight.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("_words").over(everything) - most * F.coalesce(F.sum("_words").over(capped), F.lit(0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(capped), F.lit(0))
    level = (left / weight_left).alias("_level")
    stepped = weighed.select("*", level, F.row_number().over(tight).alias("_k"))
    fits = F.col("_level") * F.col("_weight") <= most * F.col("_words")
    settled = F.first(F.when(fits, F.col("_level")), ignorenulls=True).over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cap = (most * F.col("_words")).cast("double")
    return stepped.select("_source", "_words", "_weight", F.least(cap, F.coalesce(settled, F.lit(0.0)) * F.col("_weight")).alias("_target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", carry: tuple[str, ...] = (), weight_col: str | None = None, half: int = HALF) -> DataFrame:
    """id, size, source_size, target, copies, taken, and the columns of carry, for every row of docs."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    weight = F.col(weight_col).cast("double") if weight_col else size / (size + half)
    slim = materialize(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size"), weight.alias("_weight_in"), *[F.col(c).alias(f"_with_{c}") for c in carry]), "mix-sizes")
    aims = materialize(targets(slim.groupBy("_source").agg(F.sum("_size").alias("_words")), weights, most), "mix-targets")
    whole = F.when(F.col("_words") > 0, F.floor(F.col("_target") / F.col("_words"))).otherwise(0).cast("long")
    aims = aims.withColumn("_whole", whole).withColumn("_rest", F.col("_target") - F.col("_whole") * F.col("_words"))
    f = F.when(F.col("_words") > 0, F.col("_rest") / F.col("_words")).otherwise(0.0)
    u = uniform(seed, F.col("_id"))
    rank = F.when((f > 0) & (F.col("_weight_in") > 0), (u / (1 - u)) / (F.col("_weight_in") * (f / (1 - f))))
    drawn = slim.join(aims, slim["_source"].eqNullSafe(aims["_source"])).select(slim["_source"], "_id", "_size", "_words", "_target", "_whole", "_rest", rank.alias("_rank"), *[f"_with_{c}" for c in carry])
    order = [F.col("_source").asc_nulls_last(), F.col("_rank").asc_nulls_last(), F.col("_id").asc_nulls_last(), F.col("_size").asc()]
    ranked = materialize(global_prefix(drawn, order, {"_before": "_size"}, "mix-order"), "mix-prefix")
    base = ranked.groupBy("_source").agg(F.min("_before").alias("_base"))
    within = ranked.join(base, ranked["_source"].eqNullSafe(base["_source"])).select(ranked["*"], (F.col("_before") - F.col("_base") + F.col("_size")).alias("_through"))
    sampled = within.withColumn("_in", F.col("_rank").isNotNull() & (F.col("_through") <= F.col("_rest")))
    # of what did not fit, the document nearest to the words still missing, by (distance, rank)
    missing = sampled.groupBy("_source").agg(F.max("_rest").alias("_rest"), F.coalesce(F.sum(F.when(F.col("_in"), F.col("_size"))), F.lit(0)).alias("_got"))
    missing = missing.select(F.col("_source").alias("_s"), (F.col("_rest") - F.col("_got")).alias("_gap"))
    near = sampled.join(missing, sampled["_source"].eqNullSafe(missing["_s"])).where(~F.col("_in") & F.col("_rank").isNotNull())
    off = F.abs(F.col("_gap") - F.col("_size"))
    last = near.where(off < F.col("_gap")).groupBy("_source").agg(F.min(F.struct(off.alias("o"), F.col("row_index").alias("row_index")))["row_index"].alias("_last"))
    last = last.select("_last")
    done = sampled.join(last, sampled["row_index"] == last["_last"], "left")
    copies = F.col("_whole") + F.when(F.col("_in") | F.col("_last").isNotNull(), 1).otherwise(0)
    return done.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).alias("taken"), *[F.col(f"_with_{c}").alias(c) for c in carry]
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", stored: bool = False, **how) -> DataFrame:
    """docs with each row as often as mix takes it; stored as in common.located."""
    rows = located(docs, docs.columns, stored)
    c = {name: f"_c{k}" for k, name in enumerate(docs.columns)}
    copies = mix(rows, c[id_col], c[text_col], c[source_col], carry=("_at",), **how).where("copies > 0").select("_at", "copies")
    many = rows.join(copies, "_at").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return many.select(*[F.col(v).alias(k) for k, v in c.items()])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals
), stepped AS (
  SELECT *, (CAST(sum(words) OVER () - 3 * coalesce(sum(words) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) AS level,
    row_number() OVER t AS k
  FROM weighed WINDOW t AS (ORDER BY CAST(words AS DOUBLE) / weight, source NULLS FIRST)
), settled AS (SELECT coalesce(min_by(level, k), 0.0) AS level FROM stepped WHERE level * weight <= 3 * words
), aims AS (
  SELECT source, words, least(CAST(3 * words AS DOUBLE), settled.level * weight) AS target FROM stepped, settled
), parted AS (
  SELECT *, CASE WHEN words > 0 THEN CAST(floor(target / words) AS BIGINT) ELSE 0 END AS whole FROM aims
), rested AS (SELECT *, target - whole * words AS rest FROM parted
), drawn AS (
  SELECT doc_id, s.source, size, words, target, whole, rest, CASE WHEN words > 0 THEN rest / words ELSE 0.0 END AS f,
    (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM sized s JOIN rested r ON s.source IS NOT DISTINCT FROM r.source
), ranked AS (SELECT *, CASE WHEN f > 0 AND size > 0 THEN (u / (1 - u)) / ((CAST(size AS DOUBLE) / (size + 100)) * (f / (1 - f))) END AS rank FROM drawn
), ordered AS (
  SELECT *, row_number() OVER o AS n, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) AS through
  FROM ranked WINDOW o AS (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size)
), sampled AS (SELECT *, rank IS NOT NULL AND through <= rest AS inside FROM ordered
), gaps AS (SELECT source, max(rest) - coalesce(sum(size) FILTER (WHERE inside), 0) AS gap FROM sampled GROUP BY source
), lasts AS (
  SELECT s.source, min_by(n, {'o': abs(gap - size), 'n': n}) AS n FROM sampled s JOIN gaps g ON s.source IS NOT DISTINCT FROM g.source
  WHERE NOT inside AND rank IS NOT NULL AND abs(gap - size) < gap GROUP BY s.source
)
SELECT doc_id, size, words AS source_size, target, (whole + CASE WHEN inside OR l.n IS NOT NULL THEN 1 ELSE 0 END) * size AS taken
FROM sampled s LEFT JOIN lasts l ON s.source IS NOT DISTINCT FROM l.source AND s.n = l.n
"""
