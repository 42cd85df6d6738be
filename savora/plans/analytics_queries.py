"""Registered queries of analytics, liveness, quality and recommendation, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savora.functions.text import is_open, open_ranges
from savora.operators import analytics, liveness, quality, recommend, resolve, scoring
from savora.params import TABLES as P
from savora.plans.bindings import ROLES_SQL, SHOPS_SQL, TRACKS_SQL, mentions, shops, table, tracks, unresolved
from savora.plans.ranking_queries import FACTS, RANKED, items_of, mentions_once, with_, with_cuisine
from savora.sources.store import stored

LAST = datetime(2024, 1, 30)
NOW = datetime(2024, 1, 31)
DAYS = 30
VIEWS = "action = 'view'"
TAKES = "action IN ('click', 'purchase', 'signup')"


def jobs(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("action") == "purchase", "success").when(F.col("action") == "error", "failed").otherwise("running")
    return tracks(s, d).withColumn("status", status).withColumn("tokens", F.round(F.col("value") * 100).cast("long"))


JOBS_SQL = f"{TRACKS_SQL}, jobs AS (SELECT *, CASE action WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CAST(round(value * 100) AS BIGINT) AS tokens FROM tracks)"
SPINE_SQL = "spine AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day)"
BUCKET = "CAST(created_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'"
VISITOR = "coalesce(session_key, 'e#' || CAST(event_id AS VARCHAR))"


def watched(s: SparkSession, d: str) -> DataFrame:
    """Shops with what the map search last said."""
    key = F.col("shop_id")
    seen = F.when(key % 11 != 0, F.timestamp_add("DAY", -(key % 40).cast("int"), F.lit("2024-01-31").cast("timestamp")))
    out = shops(s, d).withColumn("miss_count", (key % 13).cast("int")).withColumn("last_seen_at", seen).withColumn("poi_id", F.when(key % 3 != 0, F.concat(F.lit("p"), key.cast("string"))))
    return out.withColumn("closed_at", F.lit(None).cast("timestamp")).withColumn("last_checkin_at", F.lit(None).cast("timestamp"))


WATCHED_SQL = f"""{SHOPS_SQL}, watched AS (
  SELECT *, CAST(shop_id % 13 AS INTEGER) AS miss_count, CASE WHEN shop_id % 11 <> 0 THEN TIMESTAMP '2024-01-31' - to_days(CAST(shop_id % 40 AS INTEGER)) END AS last_seen_at, CASE WHEN shop_id % 3 <> 0 THEN 'p' || CAST(shop_id AS VARCHAR) END AS poi_id FROM shops
)"""


def history(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("action") == "click", "hit").when(F.col("action") == "error", "miss").when(F.col("action") == "purchase", "evidence")
    return tracks(s, d).select(F.col("user_id").alias("key"), F.col("created_at").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind")).where("kind is not null")


def aliases(s: SparkSession, d: str) -> DataFrame:
    return shops(s, d).select("shop_id", F.concat_ws("-", F.lower("cuisine"), (F.col("shop_id") % 500).cast("string")).alias("alias_norm"))


ALIASES_SQL = "aliases AS (SELECT shop_id, lower(cuisine) || '-' || CAST(shop_id % 500 AS VARCHAR) AS alias_norm FROM shops)"


def favourites(s: SparkSession, d: str) -> DataFrame:
    line, orders = table(s, d, "lineitem").where("l_quantity >= 49"), table(s, d, "orders")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("shop_id")).distinct()


def views(s: SparkSession, d: str) -> DataFrame:
    return tracks(s, d).where("action = 'view'").select("user_id", "event_id", (F.col("event_id") % 200).alias("shop_id"))


PREFS_SQL = """favs AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS shop_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49
), views AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM (SELECT user_id, event_id, event_id % 200 AS shop_id FROM events WHERE event_type = 'view')
), seeds AS (
  SELECT user_id, shop_id, 2 AS w, row_number() OVER (PARTITION BY user_id ORDER BY shop_id) AS seq FROM favs UNION ALL SELECT user_id, shop_id, 1, i + 1000000 FROM views WHERE i <= 20
), city_prefs AS (
  SELECT * FROM (SELECT user_id, city, sum(w) AS weight, row_number() OVER (PARTITION BY user_id ORDER BY sum(w) DESC, min(seq)) AS pos FROM seeds JOIN shops USING (shop_id) GROUP BY user_id, city) WHERE pos <= 3
), cuisine_prefs AS (
  SELECT * FROM (SELECT user_id, cuisine, sum(w) AS weight, row_number() OVER (PARTITION BY user_id ORDER BY sum(w) DESC, min(seq)) AS pos FROM seeds JOIN shops USING (shop_id) GROUP BY user_id, cuisine) WHERE pos <= 3
)"""


def taste(s: SparkSession, d: str) -> DataFrame:
    f, v, own = favourites(s, d), views(s, d), shops(s, d)
    last = v.withColumn("_i", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id").desc()))).where("_i <= 20")
    seen = f.select("user_id", "shop_id").union(last.select("user_id", "shop_id")).distinct()
    items = with_cuisine(items_of(s, d), s, d)
    return recommend.by_taste(items, analytics.preference_weights(f, v, own, "city"), analytics.preference_weights(f, v, own, "cuisine"), seen)


TASTE_SQL = with_(
    f"""{RANKED}, {PREFS_SQL}, met AS (
      SELECT c.user_id, i.shop_id, i.city, s.cuisine, i.rank, c.pos AS cp, coalesce(q.pos, 99) AS qp FROM city_prefs c JOIN items i ON i.city = c.city AND i.rank <= 12 AND i.mention_count > 0 JOIN shops s ON s.shop_id = i.shop_id LEFT JOIN cuisine_prefs q ON q.user_id = c.user_id AND q.cuisine = s.cuisine
    ), sized AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY cp RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM met
    ), fresh AS (
      SELECT * FROM sized m WHERE before < 12 AND NOT EXISTS (SELECT 1 FROM favs f WHERE f.user_id = m.user_id AND f.shop_id = m.shop_id) AND NOT EXISTS (SELECT 1 FROM views v WHERE v.user_id = m.user_id AND v.shop_id = m.shop_id AND i <= 20)
    )""",
    "SELECT user_id, shop_id, city, cuisine, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cp, qp, rank) AS pos FROM fresh) WHERE pos <= 6",
)


def placed_mentions(s: SparkSession, d: str) -> DataFrame:
    return mentions(s, d).join(shops(s, d).select("shop_id", "area"), "shop_id", "left")


def hours(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    text = F.concat(F.lit("Mon "), (size % 24).cast("string"), F.lit(":00-"), (size * 7 % 24).cast("string"), F.lit(":30"))
    return table(s, d, "part").select(F.col("p_partkey").alias("shop_id"), text.alias("text"))


def gauges(s: SparkSession, d: str) -> DataFrame:
    """One crawl job a day, its statistics nested by source."""
    e = tracks(s, d).withColumn("day", F.to_date("created_at")).withColumn("source", F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")))
    per = e.groupBy("day", "source").agg(
        F.count_if(F.col("action") != "error").alias("fetched"), F.count_if(F.col("action") == "error").alias("failed"), F.count_if(F.col("action") == "signup").alias("code_403"), F.count_if(F.col("action") == "purchase").alias("code_429"),
    )
    stats = F.map_from_entries(F.collect_list(F.struct("source", F.struct(F.lit("ok").alias("status"), "fetched", "failed", "code_403", "code_429", (F.col("code_403") + F.col("code_429") >= 5).alias("breaker")))))
    jobs_ = per.groupBy("day").agg(stats.alias("stats")).select(F.col("day").cast("timestamp").alias("created_at"), F.lit(1).alias("job_id"), "stats")
    return analytics.crawl_gauges(jobs_)


GAUGES_SQL = with_(
    f"""{TRACKS_SQL}, per AS (SELECT CAST(created_at AS DATE) AS day, 's' || CAST(user_id % 4 AS VARCHAR) AS source, count(*) FILTER (WHERE action <> 'error') AS fetched, count(*) FILTER (WHERE action = 'error') AS failed,
      count(*) FILTER (WHERE action = 'signup') AS code_403, count(*) FILTER (WHERE action = 'purchase') AS code_429 FROM tracks GROUP BY ALL)""",
    "SELECT source, round(CAST(fetched AS DOUBLE) / (fetched + failed), 4) AS success, CASE WHEN fetched > 0 THEN round(CAST(code_403 AS DOUBLE) / fetched, 4) ELSE 0.0 END AS ratio_403, CASE WHEN fetched > 0 THEN round(CAST(code_429 AS DOUBLE) / fetched, 4) ELSE 0.0 END AS ratio_429, CAST(code_403 + code_429 >= 5 AS INTEGER) AS breaker FROM per WHERE day = (SELECT max(day) FROM per)",
)


def day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def city_shops(s: SparkSession, d: str) -> DataFrame:
    return shops(s, d).select("city").distinct()


LIMIT_MINUTES, LIMIT_MOST = 60 * 24, 2
RATE_LIMIT_SQL = f"""WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), fold AS (
  SELECT user_id, event_id, k, TRUE AS accepted, [t] AS kept FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, k, len(recent) < {LIMIT_MOST} AS accepted, CASE WHEN len(recent) < {LIMIT_MOST} THEN list_append(recent, t) ELSE recent END AS kept FROM (
    SELECT e.*, list_filter(fold.kept, lambda x: x >= e.t - {LIMIT_MINUTES * 60_000_000}) AS recent FROM fold JOIN e ON e.user_id IS NOT DISTINCT FROM fold.user_id AND e.k = fold.k + 1)
) SELECT user_id, event_id, accepted FROM fold"""


def fuzzy_align(s: SparkSession, d: str) -> DataFrame:
    names = stored(unresolved(s, d).select("mid", "city", "name_norm", "address_text").distinct(), "unresolved")
    return resolve.decisions(resolve.fuzzy_matches(names, shops(s, d), P), P, names)


QUERIES = {
    "track_daily_uv": lambda s, d: day_text(analytics.daily_visitors(tracks(s, d), P, LAST, DAYS)),
    "track_totals": lambda s, d: analytics.visitor_totals(tracks(s, d), P, LAST, DAYS),
    "track_actions": lambda s, d: analytics.action_counts(tracks(s, d), P, LAST, DAYS),
    "admin_overview": lambda s, d: analytics.overview(shops=shops(s, d), mentions=mentions(s, d), events=tracks(s, d), documents=table(s, d, "documents"), customers=table(s, d, "customer")),
    "status_ratio": lambda s, d: analytics.status_histogram(jobs(s, d), "status"),
    "mention_ratios": lambda s, d: analytics.mention_ratios(placed_mentions(s, d), P),
    "jobs_by_day": lambda s, d: day_text(analytics.jobs_by_day(jobs(s, d), LAST, DAYS)),
    "jobs_summary": lambda s, d: analytics.jobs_summary(jobs(s, d), NOW, 7),
    "tokens_by_day": lambda s, d: day_text(analytics.sums_by_day(jobs(s, d), "tokens", LAST, DAYS)),
    "city_status_counts": lambda s, d: analytics.shops_by_city(city_shops(s, d), shops(s, d)),
    "crawl_gauges": gauges,
    "rolling_24h": lambda s, d: analytics.rolling(tracks(s, d), LAST, 24, "value"),
    "admin_shop_list": lambda s, d: analytics.shops_with_counts(shops(s, d), mentions(s, d), aliases(s, d), "r_d").select("shop_id", "name", "mention_count", "alias_count"),
    "latest_jobs": lambda s, d: analytics.latest_jobs(jobs(s, d), 20).select("event_id", "status"),
    "preference_weights": lambda s, d: analytics.preference_weights(favourites(s, d), views(s, d), shops(s, d), "city").select("user_id", "city", "weight", "pos"),
    "rate_limit_fold": lambda s, d: analytics.rate_limited(tracks(s, d), "user_id", LIMIT_MINUTES, LIMIT_MOST),
    "first_last_mention": lambda s, d: liveness.first_last_mention(mentions(s, d)).select("shop_id", F.date_format("first_mentioned_at", "yyyy-MM-dd").alias("first_mentioned_at"), "confident", F.date_format("last_mentioned_at", "yyyy-MM-dd").alias("last_mentioned_at")),
    "liveness_evaluate": lambda s, d: liveness.evaluate(watched(s, d), P).select("shop_id", "liveness", "miss_count"),
    "liveness_mark_misses": lambda s, d: liveness.mark_misses(watched(s, d), city_shops(s, d).select("city", F.lit("2024-01-15").cast("timestamp").alias("before"), F.char_length("city").alias("records"))).select("shop_id", "miss_count"),
    "liveness_replay": lambda s, d: liveness.replay(history(s, d), P),
    "miss_distribution": lambda s, d: liveness.miss_distribution(watched(s, d)),
    "threshold_simulation": lambda s, d: liveness.threshold_simulation(watched(s, d)),
    "duplicate_name_groups": lambda s, d: quality.duplicate_names(shops(s, d)),
    "brand_chain_flags": lambda s, d: quality.chain_groups(shops(s, d), P).select("shop_id", "stem", "chain"),
    "sibling_counts": lambda s, d: quality.chain_groups(shops(s, d), P).select("shop_id", "siblings"),
    "alias_conflicts": lambda s, d: quality.alias_conflicts(aliases(s, d), shops(s, d)),
    "duplicate_pairs_jaccard": lambda s, d: quality.duplicate_pairs_by_address(shops(s, d), 0.5),
    "duplicate_pairs_composite": lambda s, d: quality.duplicate_pairs_composite(shops(s, d), P),
    "duplicate_rate": lambda s, d: quality.duplicate_rate(quality.duplicates_by_address(shops(s, d), 0.99), shops(s, d)),
    "name_group_verdicts": lambda s, d: quality.group_verdicts(shops(s, d)),
    "field_completeness": lambda s, d: quality.completeness(mentions(s, d)),
    "influencer_intrusion": lambda s, d: quality.influencer_intrusion(items_of(s, d, m := mentions_once(s, d)), m, ("viral",)),
    "brand_notice": lambda s, d: quality.brand_notice(mentions(s, d), shops(s, d), P),
    "fuzzy_align": fuzzy_align,
    "align_in_order": lambda s, d: resolve.align_in_order(unresolved(s, d).dropDuplicates(["mid", "city", "name_norm", "address_text"]), shops(s, d), P, aliases(s, d)),
    "exact_align": lambda s, d: resolve.exact_matches(mentions(s, d).where("shop_id is null"), shops(s, d), aliases(s, d)).select("mid", "city", "name_norm", "matched_id"),
    "mention_dedup": lambda s, d: resolve.deduplicated(mentions(s, d)).select("content_id", "shop_name", "evidence", "mid"),
    "recommend_taste": taste,
    "recommend_hot": lambda s, d: recommend.hot(items_of(s, d)),
    "open_hours_minutes": lambda s, d: hours(s, d).select("shop_id", F.explode(open_ranges(F.col("text"))).alias("r")).select("shop_id", F.col("r.start").alias("opens"), F.col("r.end").alias("closes")),
    "is_open_at": lambda s, d: hours(s, d).select("shop_id", is_open(open_ranges(F.col("text")), F.lit("2024-01-31 04:15:00").cast("timestamp")).alias("is_open")),
    "most_common_name": lambda s, d: scoring.most_common(scoring.eligible(mentions(s, d), shops(s, d)), ["city", "shop_key"], "shop_name"),
}

ACTIVE = "status = 'active'"
STEMS = "stems AS (SELECT *, CASE WHEN contains(name_norm, 'widget') AND length(name_norm) - 6 >= 2 THEN left(name_norm, strpos(name_norm, 'widget') - 1) || substr(name_norm, strpos(name_norm, 'widget') + 6) ELSE name_norm END AS stem FROM shops WHERE status = 'active')"
GRAMS = "CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= 2 THEN [t] ELSE list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) END"
TOKENS = f"toks AS (SELECT *, {GRAMS} AS grams FROM (SELECT *, replace(address, ' ', '') AS t FROM shops WHERE status = 'active'))"
SIM = "CAST(len(list_intersect(x.grams, y.grams)) AS DOUBLE) / len(list_distinct(list_concat(x.grams, y.grams)))"
PAIRS = f"pairs AS (SELECT x.city, x.area, x.name_norm AS na, y.name_norm AS nb, x.shop_id AS a, y.shop_id AS b, {SIM} AS sim FROM toks x JOIN toks y ON x.city = y.city AND x.shop_id < y.shop_id)"
SQL = {
    "track_daily_uv": with_(f"{TRACKS_SQL}, {SPINE_SQL}, c AS (SELECT CAST(created_at AS DATE) AS day, count(DISTINCT CASE WHEN {VIEWS} THEN {VISITOR} END) AS view_uv, count(DISTINCT CASE WHEN {TAKES} THEN {VISITOR} END) AS takeaway_uv FROM tracks GROUP BY 1)",
        "SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(view_uv, 0) AS view_uv, coalesce(takeaway_uv, 0) AS takeaway_uv, CASE WHEN view_uv > 0 THEN round(CAST(takeaway_uv AS DOUBLE) / view_uv, 4) END AS takeaway_rate FROM spine LEFT JOIN c USING (day)"),
    "track_totals": with_(TRACKS_SQL, f"SELECT count(DISTINCT CASE WHEN {VIEWS} THEN {VISITOR} END) AS view_uv, count(DISTINCT CASE WHEN {TAKES} THEN {VISITOR} END) AS takeaway_uv FROM tracks WHERE {BUCKET}"),
    "track_actions": with_(TRACKS_SQL, f"SELECT action, count(*) AS n FROM tracks WHERE {BUCKET} GROUP BY action"),
    "admin_overview": "SELECT (SELECT count(*) FROM part) AS shops, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) AS mentions, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM customer) AS customers",
    "status_ratio": with_(JOBS_SQL, "SELECT status, count(*) AS n FROM jobs GROUP BY status"),
    "mention_ratios": with_(ROLES_SQL, f"SELECT count(*) AS mentions, round(avg(confidence), 4) AS avg_confidence, round(count(*) FILTER (WHERE confidence >= {P.confidence_min}) / CAST(count(*) AS DOUBLE), 4) AS confident_ratio, round(count(*) FILTER (WHERE address_text IS NULL) / CAST(count(*) AS DOUBLE), 4) AS missing_address_text, round(count(*) FILTER (WHERE address_text IS NULL AND area IS NULL) / CAST(count(*) AS DOUBLE), 4) AS missing_text_and_area, round(count(*) FILTER (WHERE m.shop_id IS NOT NULL AND NOT (address_text IS NULL AND area IS NULL)) / CAST(count(*) AS DOUBLE), 4) AS aligned_with_place FROM mentions m LEFT JOIN shops s ON m.shop_id = s.shop_id"),
    "jobs_by_day": with_(f"{JOBS_SQL}, {SPINE_SQL}", "SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed FROM spine LEFT JOIN jobs ON CAST(created_at AS DATE) = day GROUP BY day"),
    "jobs_summary": with_(JOBS_SQL, "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs WHERE created_at >= TIMESTAMP '2024-01-24' AND status IN ('success', 'failed')"),
    "tokens_by_day": with_(f"{JOBS_SQL}, {SPINE_SQL}", "SELECT strftime(day, '%Y-%m-%d') AS day, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total, count(event_id) AS n FROM spine LEFT JOIN jobs ON CAST(created_at AS DATE) = day GROUP BY day"),
    "city_status_counts": with_(SHOPS_SQL, f"SELECT city, count(*) FILTER (WHERE {ACTIVE}) AS active, count(*) FILTER (WHERE NOT {ACTIVE}) AS inactive FROM shops GROUP BY city"),
    "crawl_gauges": GAUGES_SQL,
    "rolling_24h": with_(TRACKS_SQL, "SELECT count(*) AS n, round(coalesce(sum(value), 0.0), 2) AS total FROM tracks WHERE created_at BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-30'"),
    "admin_shop_list": with_(f"{ROLES_SQL}, {ALIASES_SQL}", "SELECT shop_id, name, (SELECT count(*) FROM mentions m WHERE m.shop_id = s.shop_id) AS mention_count, (SELECT count(*) FROM aliases a WHERE a.shop_id = s.shop_id) AS alias_count FROM shops s WHERE name LIKE '%r_d%'"),
    "latest_jobs": with_(JOBS_SQL, "SELECT event_id, status FROM jobs ORDER BY created_at DESC, event_id DESC LIMIT 20"),
    "preference_weights": with_(f"{SHOPS_SQL}, {PREFS_SQL}", "SELECT user_id, city, CAST(weight AS BIGINT) AS weight, pos FROM city_prefs"),
    "first_last_mention": with_(ROLES_SQL, "SELECT shop_id, strftime(coalesce(min(published_at), min(crawled_at)), '%Y-%m-%d') AS first_mentioned_at, min(published_at) IS NOT NULL AS confident, strftime(max(seen_at), '%Y-%m-%d') AS last_mentioned_at FROM mentions WHERE shop_id IS NOT NULL GROUP BY shop_id"),
    "liveness_evaluate": with_(WATCHED_SQL, "SELECT shop_id, CASE WHEN liveness IN ('active', 'suspect') AND miss_count >= 10 THEN 'closed' WHEN liveness = 'active' AND miss_count >= 5 THEN 'suspect' ELSE liveness END AS liveness, miss_count FROM watched"),
    "liveness_mark_misses": with_(WATCHED_SQL, "SELECT shop_id, CAST(miss_count + CASE WHEN poi_id IS NOT NULL AND liveness <> 'closed' AND last_seen_at < TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS INTEGER) AS miss_count FROM watched"),
    "liveness_replay": """WITH h AS (SELECT user_id AS key, ts, event_id, event_type AS k FROM events WHERE event_type IN ('click', 'error', 'purchase')
      ), m AS (SELECT *, sum(CASE WHEN k <> 'error' THEN 1 ELSE 0 END) OVER w AS run, sum(CASE WHEN k = 'purchase' THEN 1 ELSE 0 END) OVER w AS life FROM h WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)
      ), n AS (SELECT *, sum(CASE WHEN k = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY key, run ORDER BY ts, event_id) AS misses FROM m
      ), l AS (SELECT key, life, max(misses) AS most, max_by(misses, {'t': ts, 'e': event_id}) AS now FROM n GROUP BY key, life
      ), z AS (SELECT key, max_by(most, life) AS most, max_by(now, life) AS now FROM l GROUP BY key)
      SELECT key, CAST(now AS BIGINT) AS miss_count, CASE WHEN most >= 10 THEN 'closed' WHEN now >= 5 THEN 'suspect' ELSE 'active' END AS liveness FROM z""",
    "miss_distribution": with_(WATCHED_SQL, "SELECT city, count(*) AS base, count(*) FILTER (WHERE o AND last_seen_at IS NOT NULL) AS seen, count(*) FILTER (WHERE o AND last_seen_at IS NULL) AS never, count(*) FILTER (WHERE o AND miss_count = 0) AS miss_0, count(*) FILTER (WHERE o AND miss_count BETWEEN 1 AND 4) AS miss_1_4, count(*) FILTER (WHERE o AND miss_count BETWEEN 5 AND 9) AS miss_5_9, count(*) FILTER (WHERE o AND miss_count >= 10) AS miss_10, max(miss_count) FILTER (WHERE o) AS most, count(*) FILTER (WHERE liveness = 'active') AS is_active, count(*) FILTER (WHERE liveness = 'suspect') AS is_suspect, count(*) FILTER (WHERE liveness = 'closed') AS is_closed, count(*) FILTER (WHERE liveness = 'relocated') AS is_relocated FROM (SELECT *, liveness <> 'closed' AS o FROM watched) GROUP BY city"),
    "threshold_simulation": with_(WATCHED_SQL, "SELECT s AS suspect_at, c AS closed_at, count(*) FILTER (WHERE miss_count >= s AND miss_count < c) AS suspects, count(*) FILTER (WHERE miss_count >= c) AS closings FROM watched, (VALUES (5, 10), (7, 14), (10, 20)) t(s, c) WHERE liveness <> 'closed' GROUP BY s, c"),
    "duplicate_name_groups": with_(SHOPS_SQL, f"SELECT city, name_norm, count(*) AS n, min(shop_id) AS first_id FROM shops WHERE {ACTIVE} GROUP BY city, name_norm HAVING count(*) > 1"),
    "brand_chain_flags": with_(f"{SHOPS_SQL}, {STEMS}", "SELECT shop_id, stem, count(*) OVER (PARTITION BY city, stem) >= 2 AS chain FROM stems"),
    "sibling_counts": with_(f"{SHOPS_SQL}, {STEMS}", "SELECT shop_id, count(*) OVER (PARTITION BY city, stem) - 1 AS siblings FROM stems"),
    "alias_conflicts": with_(f"{SHOPS_SQL}, {ALIASES_SQL}", f"SELECT alias_norm, count(DISTINCT a.shop_id) AS owners, count(DISTINCT coalesce(city, '?')) AS cities, CASE WHEN count(DISTINCT coalesce(city, '?')) > 1 THEN 'cross-city' ELSE 'same city' END AS kind FROM aliases a LEFT JOIN (SELECT * FROM shops WHERE {ACTIVE}) s USING (shop_id) GROUP BY alias_norm HAVING count(DISTINCT a.shop_id) > 1"),
    "duplicate_pairs_jaccard": with_(f"{SHOPS_SQL}, {TOKENS}", f"SELECT x.city, x.shop_id AS a, y.shop_id AS b, round({SIM}, 6) AS similarity FROM toks x JOIN toks y ON x.city = y.city AND x.area = y.area AND x.shop_id < y.shop_id WHERE round({SIM}, 6) >= 0.5"),
    "duplicate_rate": with_(f"{SHOPS_SQL}, {TOKENS}, {PAIRS}, n AS (SELECT city, count(*) AS shops FROM toks GROUP BY city), p AS (SELECT x.city, count(*) AS pairs FROM toks x JOIN toks y ON x.city = y.city AND x.area = y.area AND x.shop_id < y.shop_id WHERE round({SIM}, 6) >= 0.99 GROUP BY x.city)",
        "SELECT city, CAST(sum(coalesce(pairs, 0)) AS BIGINT) AS pairs, CAST(sum(shops) AS BIGINT) AS shops, round(CAST(sum(coalesce(pairs, 0)) AS DOUBLE) / sum(shops), 4) AS rate, round(CAST(sum(coalesce(pairs, 0)) AS DOUBLE) / sum(shops), 4) < 0.05 AS passed FROM n LEFT JOIN p USING (city) GROUP BY ROLLUP (city)"),
    "name_group_verdicts": with_(f"{SHOPS_SQL}, {TOKENS}, {PAIRS}", "SELECT city, na AS name_norm, count(*) AS pairs, CASE WHEN bool_and(sim >= 0.5) THEN 'same' WHEN bool_and(sim < 0.3) THEN 'branches' ELSE 'unclear' END AS verdict FROM pairs WHERE na = nb GROUP BY city, na"),
    "field_completeness": with_(ROLES_SQL, "SELECT count(*) AS n, round(count(*) FILTER (WHERE address_text IS NOT NULL) / CAST(count(*) AS DOUBLE), 4) AS place, round(count(*) FILTER (WHERE len(complaints) > 0) / CAST(count(*) AS DOUBLE), 4) AS words, round(count(*) FILTER (WHERE evidence IS NOT NULL) / CAST(count(*) AS DOUBLE), 4) AS proof, round(count(*) FILTER (WHERE address_text IS NOT NULL AND len(complaints) > 0 AND evidence IS NOT NULL) / CAST(count(*) AS DOUBLE), 4) AS complete FROM mentions WHERE shop_id IS NOT NULL"),
    "influencer_intrusion": with_(f"{RANKED}, h AS (SELECT DISTINCT shop_id FROM mentions WHERE contains(array_to_string(list_concat(praise, complaints, [coalesce(evidence, '')]), ' '), 'viral'))", "SELECT city, count(*) AS n, count(*) FILTER (WHERE contains(name, 'viral') OR shop_id IN (SELECT shop_id FROM h WHERE shop_id IS NOT NULL)) AS hits, round(count(*) FILTER (WHERE contains(name, 'viral') OR shop_id IN (SELECT shop_id FROM h WHERE shop_id IS NOT NULL)) / CAST(count(*) AS DOUBLE), 4) AS rate FROM items WHERE rank <= 20 GROUP BY city"),
    "brand_notice": with_(f"{ROLES_SQL}, {STEMS}, sib AS (SELECT shop_id, count(*) OVER (PARTITION BY city, stem) - 1 AS siblings FROM stems), g AS (SELECT m.shop_id, count(*) AS total, count(*) FILTER (WHERE coalesce(address_text, '') = '') AS unlocated, count(*) FILTER (WHERE m.name_norm <> s.name_norm AND contains(m.name_norm, 'widget')) AS branch_mentions FROM mentions m JOIN shops s USING (shop_id) GROUP BY m.shop_id)",
        "SELECT shop_id, total, unlocated, branch_mentions, coalesce(siblings, 0) AS siblings FROM g LEFT JOIN sib USING (shop_id) WHERE unlocated > 0 AND (coalesce(siblings, 0) > 0 OR branch_mentions > 0)"),
    "rate_limit_fold": RATE_LIMIT_SQL,
    "exact_align": with_(f"{ROLES_SQL}, {ALIASES_SQL}, al AS (SELECT city, alias_norm, max(shop_id) AS i FROM aliases JOIN (SELECT shop_id, city FROM shops WHERE {ACTIVE}) USING (shop_id) GROUP BY city, alias_norm), nm AS (SELECT city, name_norm, max(shop_id) AS i FROM shops WHERE {ACTIVE} GROUP BY city, name_norm)",
        "SELECT mid, m.city, m.name_norm, coalesce(al.i, nm.i) AS matched_id FROM mentions m LEFT JOIN al ON al.city = m.city AND al.alias_norm = m.name_norm LEFT JOIN nm ON nm.city = m.city AND nm.name_norm = m.name_norm WHERE m.shop_id IS NULL"),
    "mention_dedup": with_(ROLES_SQL, "SELECT content_id, shop_name, evidence, min(mid) AS mid FROM mentions GROUP BY content_id, shop_name, evidence"),
    "recommend_taste": TASTE_SQL,
    "recommend_hot": with_(RANKED, "SELECT city, rank, shop_id, name FROM items WHERE rank <= 3 AND mention_count > 0 ORDER BY city, rank LIMIT 6"),
    "open_hours_minutes": "SELECT p_partkey AS shop_id, CAST(p_size % 24 * 60 AS INTEGER) AS opens, CAST(p_size * 7 % 24 * 60 + 30 AS INTEGER) AS closes FROM part",
    "is_open_at": "SELECT p_partkey AS shop_id, CASE WHEN a < b THEN 735 >= a AND 735 < b ELSE 735 >= a OR 735 < b END AS is_open FROM (SELECT p_partkey, p_size % 24 * 60 AS a, p_size * 7 % 24 * 60 + 30 AS b FROM part)",
    "most_common_name": with_(FACTS, "SELECT city, shop_key, max_by(shop_name, {'n': n, 'f': -f}) AS shop_name FROM (SELECT city, shop_key, shop_name, count(*) AS n, min(mid) AS f FROM facts GROUP BY ALL) GROUP BY city, shop_key"),
}
