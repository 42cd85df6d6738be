"""Ablation of the scoring model: all variants from one set of signals, and how their rankings differ."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savora.operators.scoring import adjusted, scored, smoothed
from savora.params import Params


@dataclass(frozen=True)
class Variant:
    name: str
    params: Params
    penalties: bool = True
    rules: bool = True
    no_burst: bool = False
    tenure: bool = True


def variants(p: Params) -> list[Variant]:
    out = [Variant("baseline", p)]
    out += [Variant(f"no_{k}", replace(p, weights={**p.weights, k: 0.0})) for k in p.weights]
    out.append(Variant("uniform", replace(p, weights=dict.fromkeys(p.weights, 1 / len(p.weights)))))
    out += [Variant("no_decay", replace(p, half_life_days=0)), Variant("no_bayes", replace(p, bayes_prior=0.0))]
    out += [Variant("no_penalties", p, penalties=False), Variant("no_rules", p, rules=False), Variant("no_burst", p, no_burst=True)]
    return [*out, Variant("no_tenure_bonus", p, tenure=False), Variant("no_suspect", replace(p, suspect_multiplier=1.0))]


def variant_ranks(signals: DataFrame, p: Params) -> DataFrame:
    """variant, city, shop_id, name, rank, score for every ranked shop under every variant.

    One plan for all: each shop's signals stand once for each variant, with the variant's weights and
    switches beside them as columns, and windows go by (variant, city).
    """
    flags = {"variant": "name", "_penalties": "penalties", "_rules": "rules", "_calm": "no_burst", "_tenure": "tenure"}

    def row(v: Variant) -> Column:
        known = [F.lit(getattr(v, field)).alias(name) for name, field in flags.items()]
        numbers = [F.lit(float(x)).alias(name) for name, x in {"_prior_weight": v.params.bayes_prior, "_suspect": v.params.suspect_multiplier, **{f"_w_{k}": w for k, w in v.params.weights.items()}}.items()]
        return F.struct(*known, *numbers, F.lit(v.params.half_life_days > 0).alias("_decays"))

    each = signals.withColumn("_v", F.explode(F.array(*map(row, variants(p))))).select("*", "_v.*").drop("_v")
    each = each.withColumn("burst", F.col("burst") & ~F.col("_calm"))
    own = replace(p, weights={k: F.col(f"_w_{k}") for k in p.weights}, bayes_prior=F.col("_prior_weight"), suspect_multiplier=F.col("_suspect"))
    marks = scored(each, own, F.col("_penalties"), F.col("_rules"), F.col("_decays")).withColumn("tenure_bonus", F.when(F.col("_tenure"), F.col("tenure_bonus")).otherwise(0.0))
    final = adjusted(smoothed(marks, own, ["variant", "city"]), own).where(~F.col("excluded") & F.col("shop_id").isNotNull())
    place = Window.partitionBy("variant", "city").orderBy(F.col("score").desc(), "name", "shop_id")
    return final.select("variant", "city", "shop_id", "name", F.col("final").alias("score")).withColumn("rank", F.row_number().over(place))


def average_rank(value: str, by: list[str]):
    """Ranks from 1, equals sharing the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def compare(ranks: DataFrame) -> DataFrame:
    """Each variant against the baseline: mean Spearman correlation (cities with three shops or more that vary), overlap of the top ten, largest moves."""
    base = ranks.where("variant = 'baseline'").select("city", "shop_id", F.col("rank").alias("r0"), F.col("score").alias("s0"))
    met = ranks.where("variant <> 'baseline'").join(base, ["city", "shop_id"])
    key = ["variant", "city"]
    placed = met.withColumn("x", average_rank("score", key)).withColumn("y", average_rank("s0", key))
    varied = (F.count(F.lit(1)) >= 3) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    cities = placed.groupBy(*key).agg(
        F.when(varied, F.try_divide(F.covar_pop("x", "y"), F.sqrt(F.var_pop("x") * F.var_pop("y")))).alias("rho"), F.count_if((F.col("rank") <= 10) & (F.col("r0") <= 10)).alias("top10"), F.max(F.col("r0") - F.col("rank")).alias("up"), F.max(F.col("rank") - F.col("r0")).alias("down"),
        F.bool_or((F.col("rank") == 1) & (F.col("r0") != 1)).alias("top1"),
    )
    return cities.groupBy("variant").agg(
        F.round(F.avg("rho"), 6).alias("mean_rho"), F.sum("top10").alias("top10_overlap"), F.greatest(F.lit(0), F.max("up")).alias("max_up"), F.greatest(F.lit(0), F.max("down")).alias("max_down"), F.count_if("top1").alias("top1_changes")
    )


def summary(ranks: DataFrame, names: list[str], k: int = 30) -> DataFrame:
    """Each variant against the baseline: shops ranked by either, the top k in common, entered and left, and the mean change of score."""
    base = ranks.where("variant = 'baseline'").select("city", "shop_id", F.col("rank").alias("r0"), F.col("score").alias("s0"))
    each = base.withColumn("variant", F.explode(F.array(*map(F.lit, names))))
    both = ranks.where("variant <> 'baseline'").select("variant", "city", "shop_id", "rank", "score").join(each, ["variant", "city", "shop_id"], "full")
    met, tenth = F.col("r0").isNotNull() & F.col("rank").isNotNull(), lambda x: F.round(F.col(x) * 10).cast("long")
    was, now = F.coalesce(F.col("r0") <= k, F.lit(False)), F.coalesce(F.col("rank") <= k, F.lit(False))
    change = F.sum(F.when(met, tenth("score") - tenth("s0"))).cast("double") / 10 / F.count_if(met)
    return both.groupBy("variant").agg(
        F.count("r0").alias("n_base"), F.count("rank").alias("n_var"), F.count_if(was & now).alias("top30_overlap"), F.count_if(now & ~was).alias("entered"), F.count_if(was & ~now).alias("left_top"), F.round(change, 6).alias("score_change")
    )


def movers(ranks: DataFrame, k: int = 5) -> DataFrame:
    """The largest moves of each variant within cities, then overall."""
    base = ranks.where("variant = 'baseline'").select("city", "shop_id", F.col("rank").alias("r0"))
    met = ranks.where("variant <> 'baseline'").join(base, ["city", "shop_id"]).withColumn("move", F.abs(F.col("rank") - F.col("r0")))
    order = [F.col("move").desc(), F.col("city"), F.col("shop_id")]
    local = met.withColumn("_i", F.row_number().over(Window.partitionBy("variant", "city").orderBy(*order))).where(F.col("_i") <= k)
    return local.withColumn("_j", F.row_number().over(Window.partitionBy("variant").orderBy(*order))).where(F.col("_j") <= k).drop("_i", "_j")


def same_candidates(ranks: DataFrame, variant: str) -> DataFrame:
    """Shops that only one of baseline and variant ranks: empty when both rank the same."""
    pick = lambda name: ranks.where(F.col("variant") == name).select("city", "shop_id")
    a, b = pick("baseline"), pick(variant)
    return a.exceptAll(b).withColumn("side", F.lit("baseline")).unionByName(b.exceptAll(a).withColumn("side", F.lit("variant")))
