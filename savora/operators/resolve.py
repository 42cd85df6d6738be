"""Entity resolution: mentions to shops."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savora.functions.similarity import matching_ratios
from savora.functions.text import address_tokens, brand_stem, composite_similarity, jaccard
from savora.operators.similar import bundled, similar_names, spread
from savora.params import Params
from savora.sources.store import stored, work_dir

DECISIONS = "mid {id}, shop_id {id}, action string, reason string, score double, new_name string"


def unreviewed(mentions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Mentions without a shop that no review, of any status, has met."""
    return mentions.where("shop_id is null").join(reviews.select("mid"), "mid", "left_anti")


def exact_matches(mentions: DataFrame, shops: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases first, then names; of several owners the last one counts. Adds matched_id."""
    by_alias = aliases.join(shops.where("status = 'active'").select("shop_id", "city"), "shop_id").groupBy("city", F.col("alias_norm").alias("name_norm")).agg(F.max("shop_id").alias("_alias"))
    by_name = shops.where("status = 'active'").groupBy("city", "name_norm").agg(F.max("shop_id").alias("_name"))
    return mentions.join(by_alias, ["city", "name_norm"], "left").join(by_name, ["city", "name_norm"], "left").withColumn("matched_id", F.coalesce("_alias", "_name")).drop("_alias", "_name")


def fuzzy_matches(names: DataFrame, shops: DataFrame, p: Params) -> DataFrame:
    """For each unmatched name (mid, city, name_norm, address_text) the best score among the shops of its city, the least shop_id that has it and how many do (ties, equals within 1e-9 included).

    What is scored are distinct names and addresses of both sides, so a city costs what its different names cost; scores
    are summed up before they are shuffled, and shops of one name and address count without being joined.
    Mentions without a city meet no shop.
    """
    least = max(0.0, (p.review_threshold - p.address_weight) / p.name_weight)
    asked = stored(names.select("mid", "city", F.struct("name_norm", "address_text").alias("_key")), "asked")
    keys = stored(asked.select("city", "_key").distinct().select("*", F.col("_key.name_norm").alias("name_norm"), address_tokens(F.col("_key.address_text")).alias("_here")), "keys")
    places = shops.where("status = 'active'").groupBy("city", F.col("name_norm").alias("shop_norm"), "address").agg(F.min("shop_id").alias("shop_id"), F.count(F.lit(1)).alias("ties"))
    places = stored(places.withColumn("_there", address_tokens(F.col("address"))), "places")
    alike = similar_names(keys, places.withColumnRenamed("shop_norm", "name_norm"), ["city"], "name_norm", max(least, 0.01)).select("city", F.col("a").alias("name_norm"), F.col("b").alias("shop_norm"), F.col("similarity").alias("_n"))
    there = bundled(places, ["city", "shop_norm"], F.struct("shop_id", "ties", "_there"))
    met = spread(keys.join(alike, ["city", "name_norm"]).join(there, ["city", "shop_norm"])).select("city", "_key", "_n", "_here", F.explode("bundle").alias("_r"))
    scored = met.select("city", "_key", "_r.shop_id", "_r.ties", composite_similarity(F.col("_n"), jaccard(F.col("_here"), F.col("_r._there")), p).alias("score"))
    found = stored(scored.groupBy("city", "_key", "score").agg(F.min("shop_id").alias("shop_id"), F.sum("ties").alias("ties")), "scores")
    best = found.groupBy("city", "_key").agg(F.max("score").alias("_best"))
    equal = found.join(best, ["city", "_key"]).where(F.col("score") >= F.col("_best") - 1e-9)
    kept = equal.groupBy("city", "_key").agg(F.max("score").alias("score"), F.min("shop_id").alias("shop_id"), F.sum("ties").alias("ties"))
    return asked.join(kept, ["city", "_key"]).select("mid", "shop_id", "score", "ties")


def decisions(matches: DataFrame, p: Params, names: DataFrame) -> DataFrame:
    """Merge, review or new for each mention that has a city, from its best matches; without a match it is new and has no score."""
    g = matches.groupBy("mid").agg(F.max("score").alias("score"), F.min("shop_id").alias("shop_id"), F.sum("ties").alias("ties"))
    sure = F.coalesce((F.col("score") >= p.match_threshold) & (F.col("ties") == 1), F.lit(False))
    grey = F.coalesce(F.col("score") >= p.review_threshold, F.lit(False))
    reason = F.when((F.col("score") >= p.match_threshold) & (F.col("ties") > 1), "multiple candidates").when(grey & ~sure, "grey zone")
    every = names.where("coalesce(city, '') <> ''").select("mid").join(g, "mid", "left")
    return every.select("mid", F.when(sure | grey, F.col("shop_id")).alias("shop_id"), F.when(sure, "merge").when(grey, "review").otherwise("new").alias("action"), F.when(~sure, reason).alias("reason"), "score")


class _City:
    """What the fold knows of one city: its shops in order of arrival, and names that it has settled itself."""

    def __init__(self, name: object) -> None:
        self.name = name
        self.shops: list[dict] = []
        self.at: dict[object, int] = {}
        self.settled: dict[str, object] = {}
        self.stems: Counter[str] = Counter()

    def add(self, shop: dict) -> None:
        self.at[shop["id"]] = len(self.shops)
        self.shops.append(shop)
        self.stems[shop["stem"]] += 1

    def fill(self, shop_id: object, row: dict) -> None:
        shop = self.shops[self.at[shop_id]]
        if shop["address_text"] is None and row["address_text"]:
            shop["address_text"], shop["tokens"] = row["address_text"], row["tokens"]

    def best(self, row: dict, p: Params) -> tuple[float, list[dict]]:
        """The highest score from the review threshold on, and the shops within 1e-9 of it; what can't reach the threshold isn't scored."""
        here, scores, open_ = set(row["tokens"]), [], []
        for shop in self.shops:
            there = set(shop["tokens"])
            share = len(here & there) / len(here | there) if here and there else None
            need = p.review_threshold if share is None else (p.review_threshold * (p.name_weight + p.address_weight) - p.address_weight * share) / p.name_weight
            name = _plain_score(row["norm"], shop["norm"], need - 1e-6)
            if name is None:
                open_.append((shop, share))
            elif (score := _weighted(name, share, p)) >= p.review_threshold:
                scores.append((score, shop))
        if open_:  # all at once
            ratios = matching_ratios([row["norm"]] * len(open_), [shop["norm"] for shop, _ in open_])
            weighed = [(_weighted(float(r), share, p), shop) for r, (shop, share) in zip(ratios, open_, strict=True)]
            scores += [(score, shop) for score, shop in weighed if score >= p.review_threshold]
            scores.sort(key=lambda x: self.at[x[1]["id"]])
        top = max((s for s, _ in scores), default=0.0)
        return top, [shop for s, shop in scores if s >= top - 1e-9]


def _weighted(name: float, share: float | None, p: Params) -> float:
    return name if share is None else (p.name_weight * name + p.address_weight * share) / (p.name_weight + p.address_weight)


def _plain_score(a: str, b: str, need: float) -> float | None:
    """The similarity of two names where no matching is needed (0 where a bound shows that it stays below ``need``), else null."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.9
    total = len(a) + len(b)
    if 2 * min(len(a), len(b)) < need * total:
        return 0.0
    common = sum((Counter(a) & Counter(b)).values())
    return None if 2 * common >= need * total else 0.0


def align_in_order(mentions: DataFrame, shops: DataFrame, p: Params, aliases: DataFrame | None = None) -> DataFrame:
    """The sequential alignment, exact: shops, aliases and addresses that earlier mentions bring are visible to later ones.

    Mentions whose name is an alias or a name of an active shop of their city merge by joins. Only the others are
    folded, city by city in the order of mentions (Python: every step depends on the last), over the city's shops and,
    for each shop without an address, the first exact mention that brings one. A review's reason is "multiple
    candidates" for equals from the match threshold on, "branch" where the candidate is a chain or shares its brand stem
    with another shop of the city, else "grey zone". Mentions without a city, or with an empty one, are skipped and get
    no row. Only merges and reviews have a score. A new shop gets the id of the mention that made it, negated; mid may be
    long or a decimal(38,0). mid is unique.
    """
    kind = dict(mentions.dtypes)["mid"]
    number = pa.decimal128(38, 0) if kind.startswith("decimal") else pa.int64()
    schema = pa.schema([("mid", number), ("shop_id", number), ("action", pa.string()), ("reason", pa.string()), ("score", pa.float64()), ("new_name", pa.string())])
    active = shops.where("status = 'active'")
    named = mentions.where("coalesce(city, '') <> ''").select("city", "mid", F.coalesce("name_norm", F.lit("")).alias("name_norm"), "address_text")
    known = aliases if aliases is not None else active.select("shop_id", F.lit(None).cast("string").alias("alias_norm")).limit(0)
    met = exact_matches(named, active, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        city = _City(object())
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if row["city"] != city.name:
                    city = _City(row["city"])
                if row["kind"] == 0:
                    city.add(row)
                    continue
                if row["owner"] is not None:
                    city.fill(row["owner"], row)
                    continue
                d = {"mid": row["id"], "shop_id": city.settled.get(row["norm"]), "action": "merge", "reason": None, "score": 1.0, "new_name": None}
                if d["shop_id"] is None:
                    score, equals = city.best(row, p)
                    if equals and score >= p.match_threshold and len(equals) == 1:
                        d |= {"shop_id": equals[0]["id"], "score": score}
                        city.settled |= {row["norm"]: d["shop_id"]} if row["norm"] else {}
                    elif equals:
                        branch = equals[0]["chain"] or city.stems[equals[0]["stem"]] > 1
                        reason = "multiple candidates" if score >= p.match_threshold and len(equals) > 1 else "branch" if branch else "grey zone"
                        d |= {"shop_id": equals[0]["id"], "action": "review", "reason": reason, "score": score}
                    else:
                        d |= {"shop_id": -row["id"], "action": "new", "score": None, "new_name": row["norm"]}
                        city.add(row | {"id": -row["id"], "chain": False})
                        city.settled[row["norm"]] = -row["id"]
                if d["action"] == "merge":
                    city.fill(d["shop_id"], row)
                out.append(d)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def rows(df: DataFrame, order: int, **parts: Column) -> DataFrame:
        norm, address = F.col("name_norm"), F.col("address_text")
        return df.select("city", F.lit(order).alias("kind"), parts["id"].cast(kind).alias("id"), parts["owner"].cast(kind).alias("owner"), norm.alias("norm"), address, address_tokens(address).alias("tokens"), brand_stem(norm, p).alias("stem"), parts["chain"].alias("chain"))

    none, no = F.lit(None), F.lit(False)
    old = active.select("city", "shop_id", F.coalesce("name_norm", F.lit("")).alias("name_norm"), F.col("address").alias("address_text"), (F.coalesce("is_chain", no) if "is_chain" in shops.columns else no).alias("is_chain"))
    bare = active.where("address is null").select(F.col("shop_id").alias("matched_id"))
    first = met.where("coalesce(address_text, '') <> ''").join(bare, "matched_id", "left_semi").groupBy("matched_id").agg(*[F.min_by(c, "mid").alias(c) for c in ("city", "name_norm", "address_text")], F.min("mid").alias("mid"))
    new = met.where("matched_id is null")
    cities = new.select("city").distinct()
    fold = rows(old.join(cities, "city", "left_semi"), 0, id=F.col("shop_id"), owner=none, chain=F.col("is_chain")).unionByName(rows(first.join(cities, "city", "left_semi"), 1, id=F.col("mid"), owner=F.col("matched_id"), chain=no)).unionByName(rows(new, 1, id=F.col("mid"), owner=none, chain=no))
    folded = fold.repartition("city").sortWithinPartitions("city", "kind", "id").mapInArrow(run, DECISIONS.format(id=kind))
    exact = met.where("matched_id is not null").select("mid", F.col("matched_id").cast(kind).alias("shop_id"), F.lit("merge").alias("action"), F.lit(None).cast("string").alias("reason"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("new_name"))
    return exact.unionByName(folded)


def backfilled(shops: DataFrame, mentions: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Nulls of shops filled with the first value that a mention has; what is there wins."""
    first = mentions.where("shop_id is not null").groupBy("shop_id").agg(*[F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("mid"))).alias(f"_{c}") for c in columns])
    return shops.join(first, "shop_id", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def new_aliases(aliases: DataFrame, found: DataFrame, shops: DataFrame) -> DataFrame:
    """found: shop_id, alias, alias_norm. Empty, own and known names are skipped."""
    own = shops.select("shop_id", F.col("name_norm").alias("alias_norm"))
    once = found.where(F.coalesce("alias_norm", F.lit("")) != "").groupBy("shop_id", "alias_norm").agg(F.min("alias").alias("alias"))
    return once.join(own, ["shop_id", "alias_norm"], "left_anti").join(aliases, ["shop_id", "alias_norm"], "left_anti")


def reviewed(reviews: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts: mid, confirmed. Pending reviews become approved or rejected; others stay."""
    met = reviews.join(verdicts, "mid", "left")
    new = F.when((F.col("status") == "pending") & F.col("confirmed").isNotNull(), F.when(F.col("confirmed"), "approved").otherwise("rejected")).otherwise(F.col("status"))
    return met.withColumn("status", new).drop("confirmed")


def merged_into(spark: SparkSession, merges: DataFrame) -> DataFrame:
    """source, target of merges resolved to the last target, by pointer doubling (a logarithmic number of joins).

    Of several merges of a source the one into the least target counts. Merges in a circle have no last target: their
    least member is it, for them and for what leads to them, and keeps its own row out of the result.
    """
    work_dir(spark)  # rounds are cut by checkpoints
    now = merges.where("source <> target").groupBy("source").agg(F.min("target").alias("target")).withColumn("least", F.col("target")).checkpoint()
    n, reach = now.count(), 1
    while True:
        met = now.alias("x").join(now.alias("y"), F.col("x.target") == F.col("y.source"), "left")
        if reach >= n or met.where("y.source is not null").isEmpty():
            break
        now = met.select("x.source", F.coalesce("y.target", "x.target").alias("target"), F.least("x.least", F.coalesce("y.least", "x.least")).alias("least")).checkpoint()
        reach *= 2
    # a target that is a source still lies in a circle, all of whose members it has met
    return met.select("x.source", F.coalesce("y.least", "x.target").alias("target")).where("source <> target")


def merge_shops(shops: DataFrame, mentions: DataFrame, aliases: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves mentions and aliases of merged shops to their targets; the source's name becomes an alias; sources end as merged."""
    move = lambda df: df.join(resolved, df["shop_id"] == resolved["source"], "left").withColumn("shop_id", F.coalesce("target", "shop_id")).drop("source", "target")
    named = shops.join(resolved, shops["shop_id"] == resolved["source"]).select(F.col("target").alias("shop_id"), F.col("name_norm").alias("alias_norm"))
    own = shops.select("shop_id", F.col("name_norm").alias("alias_norm"))
    both = move(aliases.select("shop_id", "alias_norm")).unionByName(named).distinct().join(own, ["shop_id", "alias_norm"], "left_anti")
    gone = resolved.select(F.col("source").alias("shop_id"), F.lit(True).alias("_gone"))
    states = shops.join(gone, "shop_id", "left").withColumn("status", F.when(F.col("_gone"), "merged").otherwise(F.col("status"))).drop("_gone")
    return states, move(mentions), both


def deduplicated(mentions: DataFrame) -> DataFrame:
    """One mention for each shop name and evidence of a document, the first in order."""
    place = Window.partitionBy("content_id", "shop_name", "evidence").orderBy("mid")
    return mentions.withColumn("_k", F.row_number().over(place)).where("_k = 1").drop("_k")
