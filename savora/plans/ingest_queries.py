"""Registered queries of the write paths: streams and batches that go through stores, read back as tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from savora.operators import ingest
from savora.params import TABLES as P
from savora.plans.bindings import SHOPS_SQL, shops, table
from savora.plans.ranking_queries import with_
from savora.sources.store import work_path

NOW = datetime(2026, 1, 1)


def raw_contents(s, d):
    """Documents as raw contents: the language as a hint of the city, only every source's own."""
    return table(s, d, "documents").select("source", F.col("text").alias("raw_text"), F.col("doc_id").alias("seq"), F.col("lang").alias("city_hint"))


def ingested(s, d):
    """The documents as a stream into a store: each (source, text) once."""
    store = ingest.content_store(s, work_path(s, "contents"), 16)
    shape = table(s, d, "documents").schema
    rows = s.readStream.schema(shape).parquet(f"{d}/documents.parquet*").select("source", F.col("text").alias("raw_text"), F.col("doc_id").alias("seq"), F.col("lang").alias("city_hint"))
    sink = store.sink("documents", ingest.ingested(P, now=NOW))
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", work_path(s, "ingest-log")).trigger(availableNow=True).start().awaitTermination()
    return store


def ingest_upserts(s, d):
    return ingested(s, d).read("contents").select("source", "content_hash", "city_hint", "status", F.char_length("raw_text").cast("long").alias("size"))


def places(s, d):
    return table(s, d, "part").select(
        F.col("p_brand").alias("city"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("poi_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("Road "), F.col("p_size").cast("string"))).alias("address"), F.lit(None).cast("string").alias("area"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.col("p_type").alias("open_hours"),
    )


def poi_upserts(s, d):
    """Active shops, then every part as a place of the map, delivered twice."""
    store = ingest.shop_store(s, work_path(s, "shops"), 16)
    old = shops(s, d).where("status = 'active'")
    rows = old.select(F.sha2(F.col("shop_id").cast("string"), 256).alias("shop_key"), "shop_id", "city", "name", "name_norm", *[F.lit(None).cast("string").alias(c) for c in ("poi_source", "poi_id")], F.when(F.col("shop_id") % 3 == 0, F.col("address")).alias("address"), "area", *[F.lit(None).cast("double").alias(c) for c in ("lat", "lng")], F.lit(None).cast("string").alias("open_hours"), "status", "liveness", F.lit(1).cast("long").alias("miss_count"), F.lit(None).cast("timestamp").alias("last_seen_at"))
    store.commit("seed", 0, set(range(store.buckets)), {"shops": rows})
    sink = store.sink("map", ingest.places_upserted(P, NOW))
    for batch in (0, 0, 1):  # again as the same batch, and as another one
        sink(places(s, d), batch)
    return store.read("shops").select("city", "name_norm", "shop_id", "poi_id", "address", "open_hours", "liveness", "miss_count")


QUERIES = {"ingest_upserts": ingest_upserts, "poi_upserts": poi_upserts}
SQL = {
    "ingest_upserts": """SELECT coalesce(source, '') AS source, 'sha256:' || sha256(text) AS content_hash, nullif(max_by(lang, CASE WHEN coalesce(lang, '') <> '' THEN doc_id END), '') AS city_hint, 'cleaned' AS status, length(any_value(text)) AS size
      FROM documents WHERE text IS NOT NULL GROUP BY coalesce(source, ''), text""",
    "poi_upserts": with_(
        SHOPS_SQL,
        """, norms AS (SELECT p_partkey, p.p_name, p_brand AS city, 'P' || CAST(p_partkey AS VARCHAR) AS poi_id, CASE WHEN p_size % 4 <> 0 THEN 'Road ' || CAST(p_size AS VARCHAR) END AS road, p_type, s.name_norm FROM part p JOIN shops s ON s.shop_id = p.p_partkey
        ), old AS (SELECT * FROM shops WHERE status = 'active'), firsts AS (SELECT city, name_norm, min(shop_id) AS shop_id FROM old GROUP BY ALL
        ), met AS (SELECT n.*, f.shop_id FROM norms n LEFT JOIN firsts f USING (city, name_norm)
        ), news AS (SELECT city, name_norm, shop_id, max_by(poi_id, p_partkey) AS poi_id, min_by(road, CASE WHEN road IS NOT NULL THEN p_partkey END) AS road, max_by(p_type, p_partkey) AS hours FROM met GROUP BY ALL)
        SELECT coalesce(o.city, n.city) AS city, coalesce(o.name_norm, n.name_norm) AS name_norm, o.shop_id, n.poi_id, coalesce(CASE WHEN o.shop_id % 3 = 0 THEN o.address END, n.road) AS address, n.hours AS open_hours,
          CASE WHEN n.city IS NULL THEN o.liveness WHEN coalesce(o.liveness, 'active') = 'suspect' THEN 'active' ELSE coalesce(o.liveness, 'active') END AS liveness, CASE WHEN n.city IS NULL THEN 1 ELSE 0 END AS miss_count
        FROM old o FULL JOIN news n ON o.shop_id = n.shop_id""",
    ),
}
