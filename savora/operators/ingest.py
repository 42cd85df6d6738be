"""Idempotent writes end to end: raw contents with chunks and mentions, extraction of what is pending, map places with aliases.

All go through a ``Store``, so a batch that is delivered again, or whose first try failed, changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savora.functions.text import clean_fingerprint, cleaned, content_hash, shop_norm, strip
from savora.functions.time import instant
from savora.operators.chunking import chunk_list
from savora.operators.extraction import MENTION, answered, located
from savora.params import Params
from savora.sources.store import Store, work_path

CONTENT = "content_key string, source string, content_hash string, raw_text string, source_url string, city_hint string, raw_title string, raw_ref string, published_at timestamp, crawled_at timestamp, clean_text string, in_script boolean, low_trust boolean, ad_hits array<string>, status string, fingerprint string, chunk_count int"
CHUNK = "content_key string, chunk_index int, text string, start int, `end` int, tokens int, status string"
STORED_MENTION = f"content_key string, chunk_index int, place int, {MENTION}, evidence_start int, evidence_end int"
METADATA = ("source_url", "city_hint", "raw_title", "raw_ref", "published_at")
CLEANED = ("clean_text", "in_script", "low_trust", "ad_hits")


def content_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, {"contents": CONTENT, "chunks": CHUNK, "mentions": STORED_MENTION}, "content_key", buckets)


def _given(c: str) -> Column:
    """A value that is there: not null, and no empty text."""
    return F.col(c) if c == "published_at" else F.nullif(F.col(c), F.lit(""))


def _without(rows: DataFrame, keys: DataFrame, key: str = "content_key") -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def ingested(p: Params, fingerprint: str | None = None, now: datetime | None = None) -> Callable[[Store, DataFrame], tuple[set[int], dict[str, DataFrame]]]:
    """The step of a ``Store.sink``; rows: source, raw_text, seq, and any of source_url, city_hint, raw_title, raw_ref, published_at.

    A content is known by (source, hash of its text). Its metadata take the last value given, in the order of seq; what
    was cleaned under the same fingerprint stays as it is, with its chunks and mentions; everything else is cleaned and
    chunked anew, its mentions go, and it waits for extraction.
    """
    mark = fingerprint or clean_fingerprint(p)

    def step(store: Store, rows: DataFrame) -> tuple[set[int], dict[str, DataFrame]]:
        at = instant(now or datetime.now(UTC))
        wide = rows.select("source", "raw_text", "seq", *[F.col(c) if c in rows.columns else F.lit(None).cast("timestamp" if c == "published_at" else "string").alias(c) for c in METADATA])
        keyed = wide.where("raw_text is not null").withColumn("source", F.coalesce("source", F.lit(""))).withColumn("content_hash", content_hash(F.col("raw_text")))
        keyed = keyed.withColumn("content_key", F.sha2(F.concat_ws("\n", "source", "content_hash"), 256))
        last = [F.max_by(c, F.when(_given(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in METADATA]
        new = keyed.groupBy("content_key").agg(*[F.any_value(c).alias(f"_{c}") for c in ("source", "content_hash", "raw_text")], *last)
        buckets = store.touched(keyed)
        old = store.read("contents", buckets)
        met = old.join(new, "content_key", "full")
        fresh = F.col("_raw_text").isNotNull()
        filled = met.withColumns({c: F.coalesce(_given(f"_{c}") if c != "published_at" else F.col(f"_{c}"), F.col(c)) for c in METADATA} | {c: F.coalesce(c, f"_{c}") for c in ("source", "content_hash", "raw_text")})
        filled = filled.withColumn("city_hint", F.nullif(F.substring("city_hint", 1, 64), F.lit(""))).withColumn("crawled_at", F.when(fresh, at).otherwise(F.col("crawled_at")))
        kept = F.coalesce(F.col("status").isin("cleaned", "extracted") & (F.col("fingerprint") == mark), F.lit(False)) | ~fresh
        judged = filled.withColumn("_kept", kept).select(*old.columns, "_kept")
        cleaner = judged.withColumn("_c", F.when(~F.col("_kept"), cleaned(F.col("raw_text"), p)))
        whole = F.when(F.col("_c.in_script"), F.nullif("_c.text", F.lit("")))
        cut = cleaner.withColumn("_pieces", chunk_list(whole, p.max_tokens, p.overlap_tokens))
        path = work_path(store.spark, "ingest")
        cut.write.parquet(path)  # once, for contents, chunks and mentions alike: a text is cleaned and cut here and nowhere else
        stored = store.spark.read.schema(cut.schema).parquet(path)
        same, work = stored.where("_kept").select(*old.columns), stored.where("not _kept")
        done = work.withColumns({"clean_text": F.nullif("_c.text", F.lit("")), "in_script": F.col("_c.in_script"), "low_trust": F.col("_c.low_trust"), "ad_hits": F.col("_c.ad_hits"), "chunk_count": F.coalesce(F.array_size("_pieces"), F.lit(0)), "status": F.lit("cleaned"), "fingerprint": F.lit(mark)})
        pieces = work.select("content_key", F.posexplode("_pieces").alias("chunk_index", "_piece")).select("content_key", "chunk_index", "_piece.*", F.lit("pending").alias("status"))
        return buckets, {
            "contents": same.unionByName(done.select(*old.columns)),
            "chunks": _without(store.read("chunks", buckets), work).unionByName(pieces),
            "mentions": _without(store.read("mentions", buckets), work),
        }

    return step


def extract_pending(store: Store, batch: int, model: Callable[[str], str], tries: int = 3, least: float | None = None, writer: str = "extraction") -> None:
    """Asks for the chunks of all contents that are cleaned and not extracted; mentions of a content are exchanged as a whole.

    A content fails only if all its chunks do; one without chunks stays as it is.
    """
    if store.done(writer, batch):
        return
    waiting = store.read("contents").where("status = 'cleaned' and chunk_count > 0").select("content_key")
    buckets = store.touched(waiting)
    contents, chunks, mentions = (store.read(t, buckets) for t in ("contents", "chunks", "mentions"))
    asked = chunks.join(waiting, "content_key", "left_semi")
    path = work_path(store.spark, "answers")
    answers = answered(asked, model, "content_key", tries)
    answers.write.parquet(path)  # a model is asked once
    answers = store.spark.read.schema(answers.schema).parquet(path)
    outcome = answers.groupBy("content_key", "chunk_index").agg(F.bool_or("failed").alias("_failed"))
    new = chunks.join(outcome, ["content_key", "chunk_index"], "left").withColumn("status", F.when(F.col("_failed").isNull(), F.col("status")).when(F.col("_failed"), "failed").otherwise("extracted")).drop("_failed")
    failed = outcome.groupBy("content_key").agg(F.bool_and("_failed").alias("_all"))
    states = contents.join(failed, "content_key", "left").withColumn("status", F.when(F.col("_all").isNull(), F.col("status")).when(F.col("_all"), "failed").otherwise("extracted")).drop("_all")
    found = located(answers, asked, "content_key", least)
    store.commit(writer, batch, buckets, {"contents": states, "chunks": new, "mentions": _without(mentions, waiting).unionByName(found)})


SHOP = "shop_key string, shop_id long, city string, name string, name_norm string, poi_source string, poi_id string, address string, area string, lat double, lng double, open_hours string, status string, liveness string, miss_count long, last_seen_at timestamp"
ALIAS = "shop_key string, alias string, alias_norm string"


def shop_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, {"shops": SHOP, "aliases": ALIAS}, "shop_key", buckets)


def places_upserted(p: Params, seen_at: datetime, poi_source: str = "map") -> Callable[[Store, DataFrame], tuple[set[int], dict[str, DataFrame]]]:
    """The step of a ``Store.sink``; rows: city, poi_id, name, seq, address, area, lat, lng, open_hours.

    A place belongs to the shop of its city with its place id, else to the one with its normalised name (the first of
    several), else it makes a shop; within a batch, places of one id, and then of one name, that meet no shop make one
    together. Missing address, area and position are filled with the first value given, the place id and the opening
    hours are those of the last place; a normalised name that differs from the shop's becomes an alias; every shop met
    counts as seen.
    """

    def step(store: Store, rows: DataFrame) -> tuple[set[int], dict[str, DataFrame]]:
        named = rows.where("poi_id is not null and trim(coalesce(name, '')) <> ''").withColumn("_norm", F.nullif(shop_norm(F.col("name"), p), F.lit("")))
        known = store.read("shops")
        first = F.min(F.struct("shop_id", "shop_key"))["shop_key"]
        by_id = known.where((F.col("poi_source") == poi_source) & F.col("poi_id").isNotNull()).groupBy("city", "poi_id").agg(first.alias("_by_id"))
        by_name = known.groupBy("city", F.col("name_norm").alias("_norm")).agg(first.alias("_by_name"))
        met = named.join(by_id, ["city", "poi_id"], "left").join(by_name, ["city", "_norm"], "left").withColumn("_old", F.coalesce("_by_id", "_by_name"))
        same_id, same_name = Window.partitionBy("city", "poi_id"), Window.partitionBy("city", F.coalesce("_norm", "name"))
        met = met.withColumn("_old", F.coalesce("_old", F.min_by("_old", F.when(F.col("_old").isNotNull(), F.col("seq"))).over(same_id)))
        led = met.withColumn("_lead", F.when(F.col("_old").isNull(), F.struct("seq", F.coalesce("_norm", "name").alias("norm"), "poi_id")))
        for together in (same_name, same_id, same_name):
            led = led.withColumn("_lead", F.when(F.col("_old").isNull(), F.min("_lead").over(together)))
        made = F.sha2(F.concat_ws("\n", F.lit(poi_source), "city", "_lead.poi_id", "_lead.norm"), 256)
        path = work_path(store.spark, "places")
        placed = led.withColumn("shop_key", F.coalesce("_old", made)).withColumn("_new", F.col("_old").isNull()).drop("_by_id", "_by_name", "_lead", "_old")
        placed.write.parquet(path)
        placed = store.spark.read.schema(placed.schema).parquet(path)
        filled = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in ("address", "area", "lat", "lng")]
        news = placed.groupBy("shop_key").agg(
            *filled, F.max_by("poi_id", "seq").alias("_poi_id"), F.max_by("open_hours", F.when(F.nullif(strip(F.col("open_hours")), F.lit("")).isNotNull(), F.col("seq"))).alias("_open_hours"),
            F.min_by("name", "seq").alias("_name"), F.min_by(F.coalesce("_norm", "name"), "seq").alias("_name_norm"), F.any_value("city").alias("_city"),
        )
        buckets = store.touched(news)
        old = store.read("shops", buckets)
        both, seen = old.join(news, "shop_key", "full"), F.col("_poi_id").isNotNull()
        shops = both.withColumns(
            {c: F.coalesce(c, f"_{c}") for c in ("city", "name", "name_norm", "address", "area", "lat", "lng")}
            | {
                "poi_id": F.coalesce("_poi_id", "poi_id"), "poi_source": F.when(seen, poi_source).otherwise(F.col("poi_source")), "open_hours": F.coalesce("_open_hours", "open_hours"),
                "status": F.coalesce("status", F.lit("active")), "liveness": F.when(seen & (F.coalesce("liveness", F.lit("active")) == "suspect"), "active").otherwise(F.coalesce("liveness", F.lit("active"))),
                "miss_count": F.when(seen, F.lit(0)).otherwise(F.col("miss_count")).cast("long"), "last_seen_at": F.when(seen, instant(seen_at)).otherwise(F.col("last_seen_at")),
            }
        ).select(*old.columns)
        stored = store.read("aliases", buckets)
        own = shops.select("shop_key", F.col("name_norm").alias("alias_norm"))
        offered = placed.where("_norm is not null").groupBy("shop_key", F.col("_norm").alias("alias_norm")).agg(F.min_by("name", "seq").alias("alias"))
        added = offered.join(own, ["shop_key", "alias_norm"], "left_anti").join(stored, ["shop_key", "alias_norm"], "left_anti")
        return buckets, {"shops": shops, "aliases": stored.unionByName(added.select(*stored.columns))}

    return step
