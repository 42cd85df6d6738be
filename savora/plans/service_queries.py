"""Registered queries of lists, checks, detail pages and crawl summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.operators import ablation, lists, quality, ranking, scoring, service
from savora.params import TABLES as P
from savora.plans.analytics_queries import ALIASES_SQL, SQL as ANALYTICS_SQL, aliases
from savora.plans.bindings import ROLES_SQL, SHOPS_SQL, mentions, shops, table
from savora.plans.ranking_queries import OWN_SCORES, RANKED, VARIANTS, WORDS_CTE, items_of, mentions_once, reasons_sql, signals_once, with_
from savora.sources.store import stored

SHOP_KEYS, CITY_KEYS = ["user_id", "shop_id"], ["user_id", "city"]
STAMP, DUCK_STAMP = "yyyy-MM-dd HH:mm:ss", "'%Y-%m-%d %H:%M:%S'"


def requests(s: SparkSession, d: str) -> DataFrame:
    """What users ask for: event_id, at, user_id, shop_id, city, action."""
    k, kind = F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    action = F.when(kind.isin("signup", "purchase"), "add").when(kind == "error", "remove").when(kind == "click", "visit").otherwise("view")
    city = F.when(k % 50 != 13, F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string"), (k % 3 + 1).cast("string")))
    return table(s, d, "events").select("event_id", F.col("ts").alias("at"), "user_id", (k % 50 + 1).alias("shop_id"), F.coalesce(city, F.lit("nowhere")).alias("city"), action.alias("action"), k.alias("k"), "value")


REQUESTS = """requests AS (
  SELECT event_id, t_at, user_id, k % 50 + 1 AS shop_id, CASE WHEN k % 50 <> 13 THEN 'Brand#' || CAST(k % 5 + 1 AS VARCHAR) || CAST(k % 3 + 1 AS VARCHAR) ELSE 'nowhere' END AS city,
    CASE WHEN kind IN ('signup', 'purchase') THEN 'add' WHEN kind = 'error' THEN 'remove' WHEN kind = 'click' THEN 'visit' ELSE 'view' END AS action, k, value
  FROM (SELECT event_id, ts AS t_at, user_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)
)"""


def outcomes_sql(keys: str, rows: str = "requests") -> str:
    return f"SELECT *, action <> coalesce(lag(action) OVER (PARTITION BY {keys} ORDER BY t_at, event_id), 'remove') AS done FROM {rows} WHERE action IN ('add', 'remove')"


def held_sql(keys: str, rows: str = "requests") -> str:
    """held, as lists.holdings."""
    return f"""gone AS (SELECT {keys}, max({{'at': t_at, 'id': event_id}}) AS gone FROM {rows} WHERE action = 'remove' GROUP BY {keys}
), held AS (
  SELECT {keys}, min(t_at) AS since FROM {rows} LEFT JOIN gone USING ({keys}) WHERE action = 'add' AND (gone IS NULL OR {{'at': t_at, 'id': event_id}} > gone) GROUP BY {keys}
)"""


def known_cities(s: SparkSession, d: str) -> DataFrame:
    return shops(s, d).select("city").distinct()


def pack_requests(s: SparkSession, d: str) -> DataFrame:
    return requests(s, d).join(known_cities(s, d), "city", "left_semi")


PACKS = f"{SHOPS_SQL}, {REQUESTS}, packs AS (SELECT * FROM requests WHERE city IN (SELECT city FROM shops))"


def messages(s: SparkSession, d: str) -> DataFrame:
    """What users write: conv_id, turn, content, type, shop_id, images."""
    number = F.col("conv_id") + F.col("turn")
    kind = F.when(number % 3 == 0, "closed").when(number % 3 == 1, "label").otherwise(F.col("role"))
    images = F.transform(F.sequence(F.lit(0), F.col("turn") % 5), lambda x: F.concat(F.when(F.col("conv_id") % 11 == 0, "/x/").otherwise("/uploads/"), x.cast("string")))
    return table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("content"), kind.alias("type"), F.when(number % 4 != 0, F.col("conv_id") * 7 % 260).cast("long").alias("shop_id"), images.alias("images"))


MESSAGES = """messages AS (
  SELECT conv_id, turn, text AS content, CASE (conv_id + turn) % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'label' ELSE role END AS type, CASE WHEN (conv_id + turn) % 4 <> 0 THEN conv_id * 7 % 260 END AS shop_id,
    list_transform(range(0, turn % 5 + 1), lambda x: CASE WHEN conv_id % 11 = 0 THEN '/x/' ELSE '/uploads/' END || CAST(x AS VARCHAR)) AS images FROM conversations
)"""
BODY = "trim(coalesce(content, ''), ' ')"


def crawl(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Results of each source in each crawl job, and the jobs."""
    key, size = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    state = F.when(key % 7 == 0, "failed").when(key % 7 == 1, "skipped").when(key % 7 == 2, "breaker_open").otherwise("ok")
    results = table(s, d, "orders").select((key / 4).cast("long").alias("job"), key.alias("source"), state.alias("state"), (size % 97).alias("fetched"), (size % 31).alias("new"), (size % 17).alias("duplicated"), (size % 5).alias("failed"))
    job = F.col("o_orderkey")
    map_state = F.when(job % 5 == 0, "failed").when(job % 5 == 1, "partial").otherwise("ok")
    jobs = table(s, d, "orders").select((job / 4).cast("long").alias("job"), (F.col("o_orderstatus") != "P").alias("finished"), (job % 6 == 0).alias("skipped"), map_state.alias("map_state"), F.when(job % 3 != 0, F.col("o_orderpriority")).alias("city_hint"), job.alias("id"))
    return results, jobs


CRAWL = """results AS (
  SELECT o_orderkey // 4 AS job, o_orderkey AS source, CASE o_orderkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'breaker_open' ELSE 'ok' END AS state,
    p % 97 AS fetched, p % 31 AS new, p % 17 AS duplicated, p % 5 AS failed FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)
), jobs AS (
  SELECT o_orderkey AS id, o_orderkey // 4 AS job, o_orderstatus <> 'P' AS finished, o_orderkey % 6 = 0 AS skipped, CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'ok' END AS map_state,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS city_hint FROM orders
)"""
BY_CITY = {"1-URGENT": "noodles, grill", "2-HIGH": " soup ,,tea"}


def trips_of(s: SparkSession, d: str) -> DataFrame:
    return lists.trips(requests(s, d), SHOP_KEYS)


TRIPS = f"""{REQUESTS}, {held_sql("user_id, shop_id")}, seen AS (
  SELECT user_id, shop_id, min(t_at) AS visited_at FROM requests JOIN held USING (user_id, shop_id) WHERE action = 'visit' AND t_at > since GROUP BY user_id, shop_id
), trips AS (SELECT user_id, shop_id, since, visited_at, CASE WHEN visited_at IS NULL THEN 'planned' ELSE 'visited' END AS status FROM held LEFT JOIN seen USING (user_id, shop_id))"""
NOTICES = ANALYTICS_SQL["brand_notice"][len("WITH ") :]
NOTICES = NOTICES[len(ROLES_SQL) + 2 :].replace("SELECT shop_id, total, unlocated", "FINAL SELECT shop_id, total, unlocated").replace(") FINAL ", "), notices AS (", 1) + ")"


def text_of(column: str) -> Column:
    return F.date_format(column, STAMP).alias(column)


#: Whether noon's hours, 10:00-22:00, hold at the fixed time (Asia/Shanghai); 22:00-10:00 hold when they don't.
OPEN_BY_DAY = str(10 * 60 <= ((P.now.hour + 8) % 24) * 60 + P.now.minute < 22 * 60).upper()


def shop_detail(s, d):
    m = mentions_once(s, d)
    hours = F.element_at(F.array(F.lit(None).cast("string"), F.lit("ask"), F.lit("10:00-22:00"), F.lit("22:00-10:00")), (F.col("shop_id") % 4 + 1).cast("int"))
    own = shops(s, d).withColumn("open_hours", hours)
    found = stored(scoring.signals(scoring.keyed(m), own, P), "signals")
    items = ranking.rank_items(scoring.adjusted(scoring.smoothed(scoring.scored(scoring.in_business(found, own), P), P), P), P)
    got = service.shop_detail(own, items, m, quality.brand_notice(m, own, P), P, own=scoring.own_signals(found, m, own, P))
    joined = {c: F.array_join(c, sep) for c, sep in (("reasons", "; "), ("praise", "|"), ("complaints", "|"))}
    return got.withColumns(joined | {"n_sources": F.size("sources").cast("long")}).drop("sources", "open_hours")


QUERIES = {
    "favourite_outcomes": lambda s, d: lists.outcomes(requests(s, d), SHOP_KEYS).select("event_id", "done"),
    "favourite_list": lambda s, d: lists.with_shop_figures(lists.holdings(requests(s, d), SHOP_KEYS), shops(s, d), mentions(s, d)).select(*SHOP_KEYS, "name", "city", "mention_count", "last_mentioned_at", text_of("since")),
    "pack_outcomes": lambda s, d: lists.outcomes(pack_requests(s, d), CITY_KEYS).select("event_id", "done"),
    "pack_list": lambda s, d: lists.holdings(pack_requests(s, d), CITY_KEYS).join(shops(s, d).groupBy("city").agg(F.count(F.lit(1)).alias("shops")), "city").select(*CITY_KEYS, "shops", text_of("since")),
    "trip_list": lambda s, d: trips_of(s, d).select(*SHOP_KEYS, "status", text_of("since"), text_of("visited_at")),
    "trips_by_city": lambda s, d: trips_of(s, d).join(shops(s, d).select("shop_id", "city"), "shop_id").groupBy("user_id", "city").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("since", "shop_id"))), lambda x: x["shop_id"].cast("string")), ",").alias("shops")),
    "recent_cities": lambda s, d: lists.recent(requests(s, d).where("action = 'view'"), "user_id", "city"),
    "post_approvals": lambda s, d: lists.approvals(requests(s, d), SHOP_KEYS).select("event_id"),
    "post_list": lambda s, d: lists.newest(requests(s, d).where("action = 'view'"), "shop_id", 50).select("shop_id", "event_id", "place"),
    "audit_list": lambda s, d: requests(s, d).where("action = 'remove'").orderBy(F.col("at").desc(), F.col("event_id").desc()).limit(200).select("event_id", "user_id"),
    "feedback_checked": lambda s, d: service.feedback_checked(messages(s, d), shops(s, d)).select("conv_id", "turn", "type", "reject_reason", F.char_length("content").alias("n_chars")),
    "post_checked": lambda s, d: service.post_checked(messages(s, d), shops(s, d)).select("conv_id", "turn", "reject_reason"),
    "feedback_status": lambda s, d: service.status_changes(requests(s, d).withColumn("status", F.element_at(F.array(*map(F.lit, ("pending", "handling", "resolved", "rejected", "lost"))), (F.col("k") % 5 + 1).cast("int"))), "shop_id", ("pending", "handling", "resolved", "rejected")).select("event_id", "status", "previous"),
    "code_checks": lambda s, d: service.code_checks(requests(s, d).where("action in ('add', 'visit')").select(F.col("user_id").alias("mailbox"), "event_id", "at", F.when(F.col("action") == "add", "issue").otherwise("try").alias("kind"), (F.col("k") % 3).alias("code")), minutes=14_400),
    "shop_detail": shop_detail,
    "shop_lookup": lambda s, d: shops(s, d).where("shop_id = 77").select("shop_id", "name", "city"),
    "city_search": lambda s, d: known_cities(s, d).where(F.col("city").contains("#3")),
    "city_sort": lambda s, d: ranking.city_order(known_cities(s, d), items_of(s, d), shops(s, d)),
    "crawl_totals": lambda s, d: service.crawl_totals(crawl(s, d)[0]),
    "poi_rounds": lambda s, d: service.poi_rounds(crawl(s, d)[1].withColumn("job", F.col("id"))),
    "breaker_summary": lambda s, d: service.breaker_summary(*crawl(s, d)),
    "keyword_resolution": lambda s, d: service.keywords_for(table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("city_hint"), F.when(F.col("o_orderkey") % 5 == 0, "own, words").when(F.col("o_orderkey") % 5 == 1, "").alias("keywords")), BY_CITY, "food").select("o_orderkey", F.array_join("words", "|").alias("words")),
    "page_specs": lambda s, d: service.page_specs(table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" Lin = "), "url")).when(F.col("page_id") % 4 == 1, F.col("url")).when(F.col("page_id") % 4 == 2, F.concat(F.lit("="), "url")).otherwise("ftp://x=y").alias("spec")), F.lit("all")).select("page_id", "city", "url"),
    "usage_deltas": lambda s, d: service.usage_deltas(requests(s, d), "user_id", ["k"]).select("event_id", "k_delta"),
    "visit_sessions": lambda s, d: service.sessions(requests(s, d), "user_id", 600).select("user_id", text_of("start"), "n"),
    "last_mention_forward": lambda s, d: service.moved_forward(shops(s, d).select("shop_id", F.when(F.col("shop_id") % 3 != 0, F.lit("1996-06-01").cast("timestamp")).alias("last_at")), mentions(s, d).where("shop_id is not null").select("shop_id", F.col("seen_at").alias("last_at")), "shop_id", "last_at").select("shop_id", text_of("last_at")),
    "alias_added": lambda s, d: service.alias_added(aliases(s, d), requests(s, d).where("action = 'add'").select("shop_id", "at", "event_id", F.concat(F.lit("promo brushed copper-"), (F.col("k") * 3).cast("string")).alias("alias_norm"))),
    "alert_text": lambda s, d: service.alert_text(requests(s, d).where("action = 'remove'").select("user_id", "at", "event_id", F.when(F.col("k") % 2 == 0, "firing").otherwise("resolved").alias("status"), F.concat(F.lit("shop "), F.col("shop_id").cast("string")).alias("name"), F.when(F.col("k") % 3 != 0, F.col("city")).alias("summary")), "user_id"),
    "display_fields": lambda s, d: requests(s, d).select("event_id", service.price_band(F.element_at(F.array(*map(F.lit, ("0-30", "30-60", "100-", ""))), (F.col("k") % 4 + 1).cast("int"))).alias("b"), service.tenure_years(F.timestamp_add("DAY", -(F.col("k") * 20).cast("int"), F.lit("2024-01-31").cast("timestamp")), F.lit("2024-01-31").cast("timestamp")).alias("years"), service.percent_text(F.col("k") / 1000).alias("share")).select("event_id", "b.min", "b.max", "years", "share"),
    "robots_gate": lambda s, d: service.robots_allowed(table(s, d, "pages").select("page_id", "url"), hosts(s, d).select("host", F.when(F.col("n") % 5 == 0, 404).when(F.col("n") % 5 == 1, 403).when(F.col("n") % 5 == 2, 503).otherwise(200).alias("code")), robots_rules(s, d)).select("page_id", "allowed"),
    "ablation_summary": lambda s, d: ablation.summary(ablation.variant_ranks(signals_once(s, d), P), [v.name for v in ablation.variants(P)][1:]),
}


def hosts(s: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "^(https?)://([^/?#]+)", 2)
    return table(s, d, "pages").select(host.alias("host")).where("host <> ''").distinct().withColumn("n", F.char_length("host"))


def robots_rules(s: SparkSession, d: str) -> DataFrame:
    rule = lambda place, allow, path: F.struct(F.lit(place).alias("place"), F.lit(allow).alias("allow"), F.lit(path).alias("path"))
    return hosts(s, d).select("host", F.explode(F.array(rule(0, True, "/en/1"), rule(1, False, "/en/"), rule(2, False, "/de/7"), rule(3, False, ""))).alias("r")).select("host", "r.*")


SQL = {
    "code_checks": with_(
        REQUESTS,
        """, e AS (SELECT user_id AS m, event_id, epoch_us(t_at) AS t, action = 'add' AS issue, k % 3 AS code, row_number() OVER (PARTITION BY user_id ORDER BY t_at, event_id) AS n FROM requests WHERE action IN ('add', 'visit')
        ), w AS (SELECT DISTINCT m, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS STRUCT(c BIGINT, until BIGINT, f INTEGER)[]) AS codes, TRUE AS issue, FALSE AS ok FROM e
        UNION ALL SELECT m, n, event_id, CASE WHEN issue THEN list_append(open, {'c': code, 'until': t + 864000000000, 'f': 0}) WHEN pos > 0 THEN open[:pos - 1] || open[pos + 1:] WHEN len(open) = 0 THEN open
            WHEN open[-1].f + 1 >= 5 THEN open[:-2] ELSE list_append(open[:-2], {'c': open[-1].c, 'until': open[-1].until, 'f': open[-1].f + 1}) END, issue, pos > 0 AND NOT issue AND open[pos].f < 5 FROM (
          SELECT *, CASE WHEN list_contains(names, code) THEN len(open) - list_position(list_reverse(names), code) + 1 ELSE 0 END AS pos FROM (
            SELECT *, list_transform(open, lambda c: c.c) AS names FROM (
              SELECT e.m, e.n, e.event_id, e.t, e.issue, e.code, list_filter(w.codes, lambda c: c.until > e.t) AS open FROM w JOIN e ON e.m IS NOT DISTINCT FROM w.m AND e.n = w.n + 1))))
        SELECT event_id, coalesce(ok, FALSE) AS ok FROM w WHERE n > 0 AND NOT issue""",
        recursive=True,
    ),
    "favourite_outcomes": with_(REQUESTS, f"SELECT event_id, done FROM ({outcomes_sql('user_id, shop_id')})"),
    "favourite_list": with_(f"{ROLES_SQL}, {REQUESTS}, {held_sql('user_id, shop_id')}, g AS (SELECT shop_id, count(*) AS n, strftime(max(crawled_at), '%Y-%m-%d') AS last FROM mentions WHERE shop_id IS NOT NULL GROUP BY shop_id)",
        f"SELECT user_id, shop_id, name, city, coalesce(n, 0) AS mention_count, last AS last_mentioned_at, strftime(since, {DUCK_STAMP}) AS since FROM held JOIN shops USING (shop_id) LEFT JOIN g USING (shop_id)"),
    "pack_outcomes": with_(PACKS, f"SELECT event_id, done FROM ({outcomes_sql('user_id, city', 'packs')})"),
    "pack_list": with_(f"{PACKS}, {held_sql('user_id, city', 'packs')}", f"SELECT user_id, city, (SELECT count(*) FROM shops s WHERE s.city = held.city) AS shops, strftime(since, {DUCK_STAMP}) AS since FROM held"),
    "trip_list": with_(TRIPS, f"SELECT user_id, shop_id, status, strftime(since, {DUCK_STAMP}) AS since, strftime(visited_at, {DUCK_STAMP}) AS visited_at FROM trips"),
    "trips_by_city": with_(f"{SHOPS_SQL}, {TRIPS}", "SELECT user_id, city, string_agg(CAST(shop_id AS VARCHAR), ',' ORDER BY since, shop_id) AS shops FROM trips JOIN shops USING (shop_id) GROUP BY user_id, city"),
    "recent_cities": with_(f"{REQUESTS}, l AS (SELECT user_id, city, max({{'at': t_at, 'id': event_id}}) AS last FROM requests WHERE action = 'view' GROUP BY user_id, city), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, city) AS i FROM l)", "SELECT user_id, string_agg(city, ',' ORDER BY i) AS recent FROM n WHERE i <= 6 GROUP BY user_id"),
    "post_approvals": with_(REQUESTS, f"SELECT event_id FROM ({outcomes_sql('user_id, shop_id')}) WHERE done AND action = 'add'"),
    "post_list": with_(REQUESTS, "SELECT shop_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY t_at DESC, event_id DESC) AS place FROM requests WHERE action = 'view') WHERE place <= 50"),
    "audit_list": with_(REQUESTS, "SELECT event_id, user_id FROM requests WHERE action = 'remove' ORDER BY t_at DESC, event_id DESC LIMIT 200"),
    "feedback_checked": with_(f"{SHOPS_SQL}, {MESSAGES}", f"SELECT conv_id, turn, CASE WHEN type IN {service.FEEDBACK_TYPES} THEN type ELSE 'other' END AS type, CASE WHEN {BODY} = '' THEN 'blank' WHEN length({BODY}) > 500 THEN 'too long' WHEN shop_id IS NOT NULL AND shop_id NOT IN (SELECT shop_id FROM shops) THEN 'unknown shop' END AS reject_reason, length({BODY}) AS n_chars FROM messages"),
    "post_checked": with_(f"{SHOPS_SQL}, {MESSAGES}", f"SELECT conv_id, turn, CASE WHEN {BODY} = '' THEN 'blank' WHEN length({BODY}) > 300 THEN 'too long' WHEN shop_id IS NULL OR shop_id NOT IN (SELECT shop_id FROM shops) THEN 'unknown shop' WHEN len(images) > 3 THEN 'too many images' WHEN len(list_filter(images, lambda x: NOT starts_with(x, '/uploads/'))) > 0 THEN 'bad image' END AS reject_reason FROM messages"),
    "feedback_status": with_(f"{REQUESTS}, c AS (SELECT *, (['pending', 'handling', 'resolved', 'rejected', 'lost'])[k % 5 + 1] AS status FROM requests)", "SELECT event_id, status, coalesce(lag(status) OVER (PARTITION BY shop_id ORDER BY t_at, event_id), 'pending') AS previous FROM c WHERE status <> 'lost'"),
    "shop_detail": with_(
        f"{RANKED}, {NOTICES}, {WORDS_CTE.format(c='praise')}, {WORDS_CTE.format(c='complaints')}, live AS ({OWN_SCORES} SELECT shop_id, score, exclude_reason, reasons FROM scored JOIN ({reasons_sql()}) USING (city, shop_key)), f AS (SELECT shop_id, count(*) AS n, least(count(DISTINCT content_id), 10) AS ns, strftime(max(seen_at), '%Y-%m-%d') AS last, min_by(address_text, mid) AS a, strftime(coalesce(min(published_at), min(crawled_at)), '%Y-%m-%d') AS first, min(published_at) IS NOT NULL AS sure FROM mentions WHERE shop_id IS NOT NULL GROUP BY shop_id)",
        f"SELECT s.shop_id, s.name, s.city, area, coalesce(nullif(s.address, ''), a) AS address, cuisine, s.avg_price, status, s.liveness, coalesce(i.display_score, l.score, 0.0) AS score, i.rank, l.exclude_reason, coalesce(l.reasons, '') AS reasons, coalesce(p.words, '') AS praise, coalesce(c.words, '') AS complaints, coalesce(f.ns, 0) AS n_sources, "
        f"CASE s.shop_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN {OPEN_BY_DAY} ELSE NOT {OPEN_BY_DAY} END AS is_open, coalesce(f.n, 0) AS mention_count, f.last AS last_mentioned_at, f.first AS first_mentioned_at, coalesce(sure, FALSE) AS first_evidence_confident, s.shop_id IN (SELECT shop_id FROM notices) AS notice "
        "FROM shops s LEFT JOIN live l ON l.shop_id = s.shop_id LEFT JOIN items i ON i.shop_id = s.shop_id AND i.city = s.city LEFT JOIN f ON f.shop_id = s.shop_id LEFT JOIN praise_words p ON p.shop_id = s.shop_id LEFT JOIN complaints_words c ON c.shop_id = s.shop_id"),
    "shop_lookup": with_(SHOPS_SQL, "SELECT shop_id, name, city FROM shops WHERE shop_id = 77"),
    "city_search": with_(SHOPS_SQL, "SELECT DISTINCT city FROM shops WHERE contains(city, '#3')"),
    "city_sort": with_(RANKED, "SELECT c.city, r > 0 AS has_rank, r AS rank_count, n AS shop_count, row_number() OVER (ORDER BY r > 0 DESC, r DESC, n DESC, c.city) AS place FROM (SELECT city, count(*) AS n, (SELECT count(*) FROM items i WHERE i.city = shops.city) AS r FROM shops GROUP BY city) c"),
    "crawl_totals": with_(CRAWL, "SELECT job, count(*) AS sources, count(*) FILTER (WHERE state = 'ok') AS ok, count(*) FILTER (WHERE state IN ('skipped', 'breaker_open')) AS skipped, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(new) AS BIGINT) AS new, CAST(sum(duplicated) AS BIGINT) AS duplicated, CAST(sum(failed) AS BIGINT) AS failed, CASE WHEN count(*) FILTER (WHERE state = 'failed') = count(*) THEN 'failed' ELSE 'success' END AS status FROM results GROUP BY job"),
    "poi_rounds": with_(CRAWL, "SELECT coalesce(city_hint, '__global__') AS city, count(*) AS rounds FROM (SELECT * FROM jobs WHERE finished ORDER BY id DESC LIMIT 400) WHERE NOT skipped AND map_state IN ('ok', 'partial') GROUP BY ALL"),
    "breaker_summary": with_(CRAWL, "SELECT job, source, state, state = 'breaker_open' AS tripped FROM results WHERE job = (SELECT max(job) FROM jobs WHERE finished)"),
    "keyword_resolution": "SELECT o_orderkey, array_to_string(list_filter(list_transform(string_split(CASE WHEN o_orderkey % 5 = 0 THEN 'own, words' WHEN o_orderkey % 5 = 1 THEN '' WHEN o_orderpriority = '1-URGENT' THEN 'noodles, grill' WHEN o_orderpriority = '2-HIGH' THEN ' soup ,,tea' ELSE 'food' END, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS words FROM orders",
    "page_specs": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Lin' ELSE 'all' END AS city, trim(url, ' ') AS url FROM pages WHERE page_id % 4 < 3 AND regexp_matches(trim(url, ' '), '^https?://')",
    "usage_deltas": with_(f"{REQUESTS}, p AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY t_at, event_id) AS was FROM requests)", "SELECT event_id, CASE WHEN was IS NULL OR k < was THEN k ELSE k - was END AS k_delta FROM p"),
    "visit_sessions": with_(f"{REQUESTS}, p AS (SELECT *, CASE WHEN t_at - lag(t_at) OVER w < INTERVAL 600 MINUTE THEN 0 ELSE 1 END AS fresh FROM requests WINDOW w AS (PARTITION BY user_id ORDER BY t_at, event_id)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t_at, event_id) AS visit FROM p)", f"SELECT user_id, strftime(min(t_at), {DUCK_STAMP}) AS start, count(*) AS n FROM n GROUP BY user_id, visit"),
    "last_mention_forward": with_(f"{ROLES_SQL}, t AS (SELECT shop_id, max(seen_at) AS top FROM mentions WHERE shop_id IS NOT NULL GROUP BY shop_id)", f"SELECT shop_id, strftime(greatest(CASE WHEN shop_id % 3 <> 0 THEN TIMESTAMP '1996-06-01' END, CAST(top AS TIMESTAMP)), {DUCK_STAMP}) AS last_at FROM shops LEFT JOIN t USING (shop_id)"),
    "alias_added": with_(f"{SHOPS_SQL}, {ALIASES_SQL}, {REQUESTS}, w AS (SELECT 'promo brushed copper-' || CAST(k * 3 AS VARCHAR) AS alias_norm, min_by(shop_id, {{'at': t_at, 'id': event_id}}) AS shop_id FROM requests WHERE action = 'add' GROUP BY k)", "SELECT alias_norm, shop_id FROM aliases UNION ALL SELECT alias_norm, shop_id FROM w WHERE alias_norm NOT IN (SELECT alias_norm FROM aliases)"),
    "alert_text": with_(REQUESTS, "SELECT user_id, CAST(count(*) AS VARCHAR) || ' alerts' || chr(10) || string_agg('[' || CASE WHEN k % 2 = 0 THEN 'FIRING' ELSE 'RESOLVED' END || '] shop ' || CAST(shop_id AS VARCHAR) || CASE WHEN k % 3 <> 0 THEN ': ' || city ELSE '' END, chr(10) ORDER BY t_at, event_id) AS message FROM requests WHERE action = 'remove' GROUP BY user_id"),
    "display_fields": with_(REQUESTS, "SELECT event_id, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 100 END AS min, CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 60 END AS max, CAST(greatest(1, floor(k * 20 / 365.25::DOUBLE)) AS INTEGER) AS years, printf('%d.%d%%', k // 10, k % 10) AS share FROM requests"),
    "robots_gate": "WITH u AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS p FROM pages), v AS (SELECT *, length(host) % 5 AS c, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS path FROM u) "
        "SELECT page_id, CASE WHEN coalesce(host, '') = '' THEN FALSE WHEN c IN (0, 2) THEN TRUE WHEN c = 1 THEN FALSE ELSE starts_with(path, '/en/1') OR NOT (starts_with(path, '/en/') OR starts_with(path, '/de/7')) END AS allowed FROM v",
    "ablation_summary": f"WITH {VARIANTS}" + """, base AS (SELECT city, shop_id, rank AS r0, score AS s0 FROM variants WHERE variant = 'baseline'), vnames AS (SELECT DISTINCT variant FROM variants WHERE variant <> 'baseline'
      ), pairs AS (SELECT n.variant, city, shop_id, r0, s0, CAST(NULL AS BIGINT) AS rank, CAST(NULL AS DOUBLE) AS score FROM base, vnames n UNION ALL SELECT variant, city, shop_id, NULL, NULL, rank, score FROM variants WHERE variant <> 'baseline'
      ), met AS (SELECT variant, city, shop_id, max(r0) AS r0, max(s0) AS s0, max(rank) AS rank, max(score) AS score FROM pairs GROUP BY variant, city, shop_id)
      SELECT variant, count(r0) AS n_base, count(rank) AS n_var, count(*) FILTER (WHERE r0 <= 30 AND rank <= 30) AS top30_overlap, count(*) FILTER (WHERE rank <= 30 AND coalesce(r0, 31) > 30) AS entered, count(*) FILTER (WHERE r0 <= 30 AND coalesce(rank, 31) > 30) AS left_top,
        round(CAST(sum(CAST(round(score * 10) AS BIGINT) - CAST(round(s0 * 10) AS BIGINT)) FILTER (WHERE r0 IS NOT NULL AND rank IS NOT NULL) AS DOUBLE) / 10 / count(*) FILTER (WHERE r0 IS NOT NULL AND rank IS NOT NULL), 6) AS score_change FROM met GROUP BY variant""",
}
