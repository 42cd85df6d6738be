"""Registered queries of the scoring and ranking family, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.functions.text import maturity
from savora.operators import ablation, ranking, scoring
from savora.params import TABLES as P
from savora.plans.bindings import ROLES_SQL, mentions, shops
from savora.sources.store import stored

NOW = f"TIMESTAMP '{P.now:%Y-%m-%d %H:%M:%S}'"
DAY_US = 86_400_000_000


def hits(words: tuple[str, ...], text: str = "blob") -> str:
    return " + ".join(f"(length({text}) - length(replace({text}, '{w}', ''))) // {len(w)}" for w in words)


def anywhere(words: tuple[str, ...], text: str = "blob") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sat(x: str, target: float) -> str:
    return f"greatest(0.0, least(1.0, CAST({x} AS DOUBLE) / {float(target)}))"


def rnd(x: str, n: int) -> str:
    """Half-even rounding of the double's exact value: printf writes its exact digits."""
    return f"(CAST(printf('%.{n}f', CAST({x} AS DOUBLE)) AS DOUBLE) + 0.0::DOUBLE)"


def age(at: str) -> str:
    return f"CAST(floor(CAST(epoch_us({NOW}) - epoch_us({at}) AS DOUBLE) / {DAY_US}) AS BIGINT)"


FACTS = f"""{ROLES_SQL}, facts AS (
  SELECT *, CASE WHEN shop_id IS NOT NULL THEN 'restaurant:' || CAST(shop_id AS VARCHAR) ELSE 'name:' || name_norm END AS shop_key,
    array_to_string(list_concat(praise, complaints, [coalesce(evidence, '')]), ' ') AS blob,
    coalesce(source_url, platform || '#' || CAST(content_id AS VARCHAR)) AS src
  FROM mentions m WHERE NOT EXISTS (SELECT 1 FROM shops s WHERE s.shop_id = m.shop_id AND (status <> 'active' OR liveness = 'closed' OR is_chain))
)"""
BURSTS = f"""bursts AS (
  SELECT city, shop_key, max(k) >= {P.burst_min} AS burst FROM (
    SELECT city, shop_key, count(*) OVER (PARTITION BY city, shop_key, platform ORDER BY epoch_us(seen_at) RANGE BETWEEN {(P.burst_window_days + 1) * DAY_US - 1} PRECEDING AND CURRENT ROW) AS k
    FROM facts WHERE sentiment = 'positive') GROUP BY city, shop_key
)"""
SIGNALS = f"""{FACTS}, {BURSTS}, names AS (
  SELECT city, shop_key, max_by(shop_name, {{'n': n, 'f': -f}}) AS raw_name FROM (
    SELECT city, shop_key, shop_name, count(*) AS n, min(mid) AS f FROM facts WHERE shop_id IS NULL GROUP BY ALL) GROUP BY city, shop_key
), aggs AS (
  SELECT city, shop_key, max(shop_id) AS shop_id, count(*) AS mention_count, count(DISTINCT src) AS independent_sources, count(*) FILTER (WHERE sentiment = 'positive') AS positives,
    count(*) FILTER (WHERE sentiment = 'positive') * 1.0::DOUBLE + count(*) FILTER (WHERE sentiment = 'mixed') * 0.5::DOUBLE + count(*) FILTER (WHERE sentiment = 'neutral') * 0.2::DOUBLE AS intensity_sum,
    count(*) FILTER (WHERE author_city IS NOT NULL) AS local_known, count(*) FILTER (WHERE author_city = content_city) AS local_equal,
    min(seen_at) AS earliest_at, max(seen_at) AS latest_at, min(seen_at) FILTER (WHERE at_is_published) AS first_confident_at, bool_or({anywhere(P.chain_words)}) AS chain0,
    CAST(sum({hits(P.unique_words)}) AS BIGINT) AS unique_hits, count(*) FILTER (WHERE {anywhere(P.plain_room_words)} AND (is_recommendation OR sentiment IN ('positive', 'mixed'))) AS paradox_count,
    count(*) FILTER (WHERE low_trust) AS ad_count, CAST(sum({hits(P.influencer_words)}) AS BIGINT) AS influencer_hits, count(*) FILTER (WHERE {anywhere(P.hygiene_words)}) AS hygiene_count,
    min_by(address_text, mid) FILTER (WHERE address_text <> '') AS mention_address
  FROM facts GROUP BY city, shop_key
), signals AS (
  SELECT a.city, a.shop_key, a.shop_id, coalesce(s.name, raw_name, a.shop_key) AS name, mention_count, independent_sources, positives, intensity_sum, local_known, local_equal, avg_price,
    earliest_at, latest_at, first_confident_at, chain0 OR {anywhere(P.chain_words, "coalesce(s.name, raw_name, a.shop_key)")} AS chain_flag, unique_hits, paradox_count, ad_count, influencer_hits, hygiene_count,
    coalesce(burst, FALSE) AS burst, coalesce(nullif(s.address, ''), mention_address) AS address, coalesce(liveness, 'active') AS liveness
  FROM aggs a LEFT JOIN shops s USING (shop_id) LEFT JOIN names n ON n.city = a.city AND n.shop_key = a.shop_key LEFT JOIN bursts b ON b.city = a.city AND b.shop_key = a.shop_key
)"""
FEATURES = {
    "real_mention_volume": sat("independent_sources", P.mention_target),
    "sentiment_strength": "greatest(0.0, least(1.0, (CAST(positives AS DOUBLE) / mention_count) * (intensity_sum / mention_count)))",
    "locality": "greatest(0.0, least(1.0, CASE WHEN local_known > 0 THEN CAST(local_equal AS DOUBLE) / local_known ELSE 0.5 END))",
    "price_friendliness": f"CASE WHEN avg_price IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - avg_price / {P.price_ceiling})) END",
    "tenure": sat(f"coalesce({age('earliest_at')}, 0)", P.span_target_days),
    "non_chain": "CASE WHEN chain_flag THEN 0.0 ELSE 1.0 END",
    "uniqueness": sat("unique_hits", P.unique_target),
    "paradox_good": sat("paradox_count", P.paradox_target),
}
PENALTIES = {
    "marketing_trace": f"greatest(0.0, least(1.0, (CAST(ad_count AS DOUBLE) / mention_count) / {P.ad_exclude_ratio}))",
    "influencer_label": sat("influencer_hits", P.influencer_target),
    "chain_attribute": "CASE WHEN chain_flag THEN 1.0 ELSE 0.0 END",
    "price_inflation": f"CASE WHEN avg_price IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (avg_price - {P.price_ceiling}) / {P.price_ceiling})) END",
    "hygiene_risk": sat("hygiene_count", P.hygiene_target),
}


def features_sql(weights: dict[str, float] | None = None) -> str:
    w = weights or P.weights
    return ", ".join(f"{rnd(v, 4)} AS f_{k}, {rnd(f'CAST({v} AS DOUBLE) * {w[k]}::DOUBLE', 4)} AS c_{k}" for k, v in FEATURES.items())


PENALTIES_SQL = ", ".join(f"{rnd(v, 4)} AS p_{k}" for k, v in PENALTIES.items())
BRANDS = " ".join(f"WHEN contains(name, '{b}') THEN 'brand:{b}'" for b in P.chain_brands)
REASON = f"CASE WHEN CAST(ad_count AS DOUBLE) / mention_count >= {P.ad_exclude_ratio} THEN 'ads' {BRANDS} WHEN {anywhere(P.mall_words, 'address')} THEN 'mall' END"
GAIN, LOSS = " + ".join(f"c_{k}" for k in FEATURES), " + ".join(f"p_{k}" for k in PENALTIES)
DECAY = f"CASE WHEN latest_at IS NULL THEN 1.0 ELSE (CAST(printf('%.4f', CAST(pow(0.5::DOUBLE, CAST(greatest(0, {age('latest_at')}) AS DOUBLE) / {P.half_life_days}) AS DOUBLE)) AS DOUBLE) + 0.0::DOUBLE) END"
BONUS = f"CASE WHEN {age('first_confident_at')} >= 3650 THEN {P.tenure_decade}::DOUBLE WHEN {age('first_confident_at')} >= 1825 THEN {P.tenure_half_decade}::DOUBLE ELSE 0.0 END"
SCORED = f"""{SIGNALS}, marked AS (SELECT *, {features_sql()}, {PENALTIES_SQL} FROM signals
), ruled AS (
  SELECT *, (CAST(printf('%.4f', CAST(({GAIN}) - ({LOSS}) AS DOUBLE)) AS DOUBLE) + 0.0::DOUBLE) AS base_score, {REASON} AS exclude_reason, CAST({DECAY} AS DOUBLE) AS time_decay, (CAST(printf('%.4f', CAST({sat("mention_count", P.confidence_target)} AS DOUBLE)) AS DOUBLE) + 0.0::DOUBLE) AS confidence FROM marked
), scored AS (
  SELECT *, exclude_reason IS NOT NULL AS excluded, CASE WHEN burst AND exclude_reason IS NULL THEN 0.5 ELSE 1.0 END AS multiplier,
    CASE WHEN exclude_reason IS NOT NULL THEN 0.0 ELSE (CAST(printf('%.1f', CAST(greatest(0.0, least(1.0, 5 * greatest(0.0, base_score) * time_decay * (CASE WHEN burst THEN 0.5 ELSE 1.0 END) / 5)) * 5 AS DOUBLE)) AS DOUBLE) + 0.0::DOUBLE) END AS score,
    CASE WHEN exclude_reason IS NOT NULL THEN 0.0 ELSE {BONUS} END AS tenure_bonus
  FROM ruled
)"""
SMOOTHED = f"""{SCORED}, priors AS (
  SELECT city, sum(CAST(round(score * 10) AS BIGINT)) / 10.0::DOUBLE / count(*) AS prior, count(*) AS k FROM scored WHERE NOT excluded GROUP BY city
), smoothed AS (
  SELECT s.*, CASE WHEN NOT excluded AND k >= 2 THEN (CAST(printf('%.1f', CAST(greatest(0.0, least(5.0, ({P.bayes_prior}::DOUBLE * prior + mention_count * score) / ({P.bayes_prior}::DOUBLE + mention_count))) AS DOUBLE)) AS DOUBLE) + 0.0::DOUBLE) ELSE score END AS smoothed
  FROM scored s LEFT JOIN priors USING (city)
)"""
ADJUSTED = f"""{SMOOTHED}, raised AS (
  SELECT *, CASE WHEN NOT excluded AND tenure_bonus > 0 THEN (CAST(printf('%.1f', CAST(greatest(0.0, least(5.0, smoothed + tenure_bonus)) AS DOUBLE)) AS DOUBLE) + 0.0::DOUBLE) ELSE smoothed END AS up FROM smoothed
), adjusted AS (
  SELECT *, CASE WHEN NOT excluded AND liveness = 'suspect' THEN (CAST(printf('%.1f', CAST(greatest(0.0, least(5.0, up * {P.suspect_multiplier})) AS DOUBLE)) AS DOUBLE) + 0.0::DOUBLE) ELSE up END AS final FROM raised
)"""
RANKED = f"""{ADJUSTED}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY final DESC, name, shop_id) AS rank FROM adjusted WHERE shop_id IS NOT NULL AND NOT excluded
), items AS (
  SELECT *, (CAST(printf('%.1f', CAST(1 + 3.9 * CASE WHEN n > 1 THEN CAST(n - rank AS DOUBLE) / (n - 1) ELSE 1.0 END AS DOUBLE)) AS DOUBLE) + 0.0::DOUBLE) AS display_score FROM (SELECT *, count(*) OVER (PARTITION BY city) AS n FROM placed WHERE rank <= {P.top_n})
)"""


#: Scores of all shops that are mentioned, whatever their state, as a query of its own.
OWN_FACTS = FACTS.replace(f"{ROLES_SQL}, ", "WITH ").replace("WHERE NOT EXISTS (SELECT 1 FROM shops s WHERE s.shop_id = m.shop_id AND (status <> 'active' OR liveness = 'closed' OR is_chain))", "WHERE shop_id IS NOT NULL")
OWN_SCORES = f"{OWN_FACTS}{SCORED.removeprefix(FACTS)}"


def with_(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"


def mentions_once(s: SparkSession, d: str) -> DataFrame:
    """Mentions for plans that read them several times: the six tables are joined once."""
    return mentions(s, d, once=True)


def signals_of(s: SparkSession, d: str, m: DataFrame | None = None) -> DataFrame:
    own = shops(s, d)
    return scoring.signals(scoring.eligible(mentions_once(s, d) if m is None else m, own), own, P)


def signals_once(s: SparkSession, d: str) -> DataFrame:
    """Signals for plans that read them several times: one row a shop, made once."""
    return stored(signals_of(s, d), "signals")


def scored_of(s: SparkSession, d: str) -> DataFrame:
    return scoring.scored(signals_of(s, d), P)


def scores_of(s: SparkSession, d: str, m: DataFrame | None = None) -> DataFrame:
    return scoring.shop_scores(mentions_once(s, d) if m is None else m, shops(s, d), P)


def items_of(s: SparkSession, d: str, m: DataFrame | None = None) -> DataFrame:
    return ranking.rank_items(scores_of(s, d, m), P)


def dated_shops(s: SparkSession, d: str, m: DataFrame) -> DataFrame:
    last = m.where("shop_id is not null").groupBy("shop_id").agg(F.max("seen_at").alias("last_mentioned_at"))
    return shops(s, d).join(last, "shop_id", "left")


SIGNAL_COLS = "city, shop_key, shop_id, name, mention_count, independent_sources, positives, intensity_sum, local_known, local_equal, avg_price, chain_flag, unique_hits, paradox_count, ad_count, influencer_hits, hygiene_count, burst, address, liveness".split(", ")
ITEM_COLS = "city rank shop_id name avg_price final display_score mention_count liveness".split()
F_COLS = ["city", "shop_key", *[f"{x}_{k}" for k in FEATURES for x in "fc"]]
P_COLS = ["city", "shop_key", *[f"p_{k}" for k in PENALTIES]]
CUISINE_JOIN = "JOIN shops USING (shop_id)"


def with_cuisine(items: DataFrame, s: SparkSession, d: str) -> DataFrame:
    return items.join(shops(s, d).select("shop_id", "cuisine", "area"), "shop_id")


def envelopes_of(s: SparkSession, d: str) -> DataFrame:
    """The items, few, are made once for the counts before and after the filter."""
    items = stored(with_cuisine(items_of(s, d), s, d).select("city", "shop_id", "area"), "items")
    return ranking.envelopes(items, ranking.filtered(items, area="A3"))


def filter_page(s: SparkSession, d: str) -> DataFrame:
    found = ranking.filtered(with_cuisine(items_of(s, d), s, d), cuisine="ECON", price_min=50, price_max=120)
    return ranking.page(found, 1, 5).select("city", "rank", "shop_id", "name", "cuisine", "avg_price")


def days_filter(s: SparkSession, d: str) -> DataFrame:
    m = mentions_once(s, d)
    return ranking.within_days(items_of(s, d, m), dated_shops(s, d, m), 120, P).select("city", "rank", "shop_id", "name", "final")


def snapshots(s: SparkSession, d: str) -> DataFrame:
    """Rank snapshots by month and shop city, generated late for some, so that the two latest differ."""
    m = mentions(s, d).select("city", F.date_trunc("month", "seen_at").alias("month")).distinct()
    number = F.year("month") * 12 + F.month("month")
    return m.select("city", number.cast("long").alias("snapshot_id"), (F.col("month") + F.expr("make_interval(0, 0, 0, 0)") + F.when(number % 5 == 0, F.expr("interval 90 days")).otherwise(F.expr("interval 0 days"))).alias("generated_at"))


SNAPSHOTS_SQL = f"""{ROLES_SQL}, months AS (SELECT DISTINCT city, date_trunc('month', seen_at) AS month FROM mentions
), snapshots AS (
  SELECT city, CAST(year(month) * 12 + month(month) AS BIGINT) AS snapshot_id, CAST(month AS TIMESTAMP) + CASE WHEN (year(month) * 12 + month(month)) % 5 = 0 THEN INTERVAL 90 DAY ELSE INTERVAL 0 DAY END AS generated_at FROM months
)"""


def city_list_of(s: SparkSession, d: str) -> DataFrame:
    m, own = mentions_once(s, d), shops(s, d)
    return ranking.city_list(own.select("city").distinct(), m.select("city", "content_id").distinct(), own, items_of(s, d, m))


def variants_of(s: SparkSession, d: str) -> DataFrame:
    return ablation.variant_ranks(signals_once(s, d), P).select("variant", "city", "shop_id", "rank", "score")


def variants_sql() -> str:
    """The same plan, once more for each variant, over signals that are computed once."""
    parts = []
    for v in ablation.variants(P):
        w, q = v.params.weights, v.params
        feats = ", ".join(f"{rnd(f'CAST({x} AS DOUBLE) * {w[k]!r}::DOUBLE', 4)} AS c_{k}" for k, x in FEATURES.items())
        reason = REASON if v.rules else "CAST(NULL AS VARCHAR)"
        decay = "1.0::DOUBLE" if q.half_life_days <= 0 else f"CAST({DECAY} AS DOUBLE)"
        burst = "FALSE" if v.no_burst else "burst"
        bonus = BONUS if v.tenure else "0.0"
        mean = f"greatest(0.0, least(5.0, ({q.bayes_prior}::DOUBLE * (sum(CASE WHEN NOT excluded THEN CAST(round(score * 10) AS BIGINT) END) OVER c / 10.0::DOUBLE / count(*) FILTER (WHERE NOT excluded) OVER c) + mention_count * score) / ({q.bayes_prior}::DOUBLE + mention_count)))"
        lowered, raised = f"greatest(0.0, least(5.0, up * {q.suspect_multiplier}))", "greatest(0.0, least(5.0, smooth + bonus))"
        quality = f"greatest(0.0, least(1.0, 5 * greatest(0.0, base) * decay * (CASE WHEN {burst} THEN 0.5 ELSE 1.0 END) / 5)) * 5"
        total = f"({GAIN}){' - (' + LOSS + ')' if v.penalties else ''}"
        smooth = f"CASE WHEN NOT excluded AND count(*) FILTER (WHERE NOT excluded) OVER c >= 2 THEN {rnd(mean, 1)} ELSE score END" if q.bayes_prior > 0 else "score"
        parts.append(f"""SELECT '{v.name}' AS variant, city, shop_id, row_number() OVER (PARTITION BY city ORDER BY score DESC, name, shop_id) AS rank, score FROM (
          SELECT city, shop_id, name, CASE WHEN liveness = 'suspect' THEN {rnd(lowered, 1)} ELSE up END AS score FROM (
            SELECT *, CASE WHEN bonus > 0 THEN {rnd(raised, 1)} ELSE smooth END AS up FROM (
              SELECT *, {smooth} AS smooth FROM (
                SELECT *, reason IS NOT NULL AS excluded, CASE WHEN reason IS NOT NULL THEN 0.0 ELSE {rnd(quality, 1)} END AS score FROM (
                  SELECT *, {rnd(total, 4)} AS base, {reason} AS reason, {decay} AS decay, CAST({bonus} AS DOUBLE) AS bonus FROM (
                    SELECT *, {feats}, {PENALTIES_SQL} FROM signals)))
              WINDOW c AS (PARTITION BY city)) WHERE NOT excluded AND shop_id IS NOT NULL))""")
    return f"{SIGNALS}, variants AS (" + " UNION ALL ".join(parts) + ")"


def spearman_of(s: SparkSession, d: str) -> DataFrame:
    return ablation.compare(ablation.variant_ranks(signals_once(s, d), P))


SPEARMAN_SQL = """, base AS (SELECT city, shop_id, rank AS r0, score AS s0 FROM variants WHERE variant = 'baseline'
), met AS (SELECT v.variant, v.city, v.shop_id, v.rank, b.r0, v.score, b.s0 FROM variants v JOIN base b USING (city, shop_id) WHERE v.variant <> 'baseline'
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY variant, city ORDER BY score) + (count(*) OVER (PARTITION BY variant, city, score) - 1) / 2.0::DOUBLE AS x,
    rank() OVER (PARTITION BY variant, city ORDER BY s0) + (count(*) OVER (PARTITION BY variant, city, s0) - 1) / 2.0::DOUBLE AS y FROM met
), cities AS (
  SELECT variant, city, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS rho,
    count(*) FILTER (WHERE rank <= 10 AND r0 <= 10) AS top10, max(r0 - rank) AS up, max(rank - r0) AS down, bool_or(rank = 1 AND r0 <> 1) AS top1_changed FROM ranked GROUP BY variant, city
)
SELECT variant, round(avg(rho), 6) AS mean_rho, CAST(sum(top10) AS BIGINT) AS top10_overlap, greatest(0, max(up)) AS max_up, greatest(0, max(down)) AS max_down, count(*) FILTER (WHERE top1_changed) AS top1_changes FROM cities GROUP BY variant"""


def words_of(s: SparkSession, d: str) -> DataFrame:
    return ranking.top_words(mentions(s, d), "praise").select("shop_id", F.array_join("praise", "|").alias("words"))


def enriched_of(s: SparkSession, d: str) -> DataFrame:
    m = mentions_once(s, d)
    got = ranking.enriched(items_of(s, d, m), m)
    return got.select("city", "rank", "shop_id", "address", F.array_join("praise", "|").alias("praise"), F.array_join("complaints", "|").alias("complaints"), F.size("sources").alias("n_sources"), "last_mentioned_at")


WORDS_CTE = """{c}_counts AS (
  SELECT shop_id, word, count(*) AS n, min({{'m': mid, 'i': i}}) AS f FROM (SELECT shop_id, mid, unnest({c}) AS word, unnest(range(len({c}))) AS i FROM mentions WHERE shop_id IS NOT NULL) GROUP BY shop_id, word
), {c}_words AS (
  SELECT shop_id, string_agg(word, '|' ORDER BY k) AS words FROM (SELECT shop_id, word, row_number() OVER (PARTITION BY shop_id ORDER BY n DESC, f) AS k FROM {c}_counts) WHERE k <= 5 GROUP BY shop_id
)"""
SOURCES_CTE = """contents AS (SELECT *, row_number() OVER (PARTITION BY shop_id, content_id ORDER BY mid) AS k FROM mentions WHERE shop_id IS NOT NULL
), sources AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY mid) AS i FROM contents WHERE k = 1) WHERE i <= 3
)"""


def q(build, *cols):
    return lambda s, d: build(s, d).select(*cols)


QUERIES = {
    "rank_city_topn": q(items_of, *ITEM_COLS),
    "shop_signals": q(signals_of, *SIGNAL_COLS),
    "shop_features": lambda s, d: scoring.features(signals_of(s, d), P).select(*F_COLS),
    "shop_penalties": lambda s, d: scoring.penalties(signals_of(s, d), P).select(*P_COLS),
    "shop_quality_score": q(scored_of, "city", "shop_key", "base_score", "time_decay", "confidence", "multiplier", "score"),
    "hard_rule_reason": q(scored_of, "city", "shop_key", "exclude_reason", "excluded"),
    "time_decay": q(scored_of, "city", "shop_key", "time_decay"),
    "tenure_bonus": q(scored_of, "city", "shop_key", "tenure_bonus"),
    "burst_flag": lambda s, d: scoring.bursts(scoring.eligible(mentions(s, d), shops(s, d)), P),
    "bayes_smooth": lambda s, d: scoring.smoothed(scored_of(s, d), P).select("city", "shop_key", "score", "smoothed"),
    "liveness_tenure_adjust": q(scores_of, "city", "shop_key", "smoothed", "liveness", "final"),
    "display_score": q(items_of, "city", "shop_id", "rank", "display_score"),
    "rank_reasons": lambda s, d: signals_of(s, d).select("city", "shop_key", F.array_join(scoring.reasons(P), "; ").alias("reasons")),
    "rank_enriched": enriched_of,
    "ablation_variants": variants_of,
    "ablation_spearman": spearman_of,
    "topk_keywords_per_shop": words_of,
    "sources_first_n": lambda s, d: ranking.first_sources(mentions(s, d)).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd")),
    "rank_filter_page": filter_page,
    "rank_days_filter": days_filter,
    "rank_envelope": envelopes_of,
    "city_list_full_outer": city_list_of,
    "city_maturity": lambda s, d: shops(s, d).groupBy("city").agg(F.count(F.lit(1)).alias("n")).select("city", "n", maturity(F.col("n")).alias("tier")),
    "latest_snapshot_by_time": lambda s, d: ranking.latest_by_time(snapshots(s, d)).select("city", "snapshot_id"),
    "latest_snapshot_by_id": lambda s, d: ranking.latest_by_id(snapshots(s, d)),
}


def reasons_sql() -> str:
    fc = f"greatest(0, {age('first_confident_at')})"
    lines = [
        "CASE WHEN independent_sources >= 2 THEN independent_sources::VARCHAR || ' independent sources' WHEN mention_count > 0 THEN mention_count::VARCHAR || ' public mentions' END",
        "CASE WHEN positives > 0 THEN 'praised ' || positives::VARCHAR || ' times' END",
        "CASE WHEN local_known > 0 AND local_equal * 2 >= local_known THEN 'locals agree (' || local_equal::VARCHAR || '/' || local_known::VARCHAR || ')' END",
        "CASE WHEN avg_price > 0 THEN 'about ' || CAST(floor(avg_price) AS BIGINT)::VARCHAR || ' a head' END",
        f"CASE WHEN first_confident_at IS NULL THEN NULL WHEN {fc} >= 365 THEN 'reports over ' || CAST(round({fc} / 365.0::DOUBLE) AS INTEGER)::VARCHAR || ' years' WHEN {fc} >= 90 THEN 'reports over ' || CAST(round_even({fc} / 30.0::DOUBLE, 0) AS INTEGER)::VARCHAR || ' months' END",
        "CASE WHEN unique_hits > 0 THEN 'a local secret' END",
        "CASE WHEN paradox_count > 0 THEN 'plain room, good food' END",
        "CASE WHEN burst THEN 'burst of praise, lowered' END",
        "CASE WHEN influencer_hits > 0 THEN 'influencer wording, lowered' END",
        "CASE WHEN hygiene_count > 0 THEN 'hygiene complaints' END",
        "CASE WHEN liveness = 'suspect' THEN 'not found on the map lately' END",
    ]
    return f"SELECT city, shop_key, array_to_string(list_slice(list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL), 1, 8), '; ') AS reasons FROM signals"


VARIANTS = variants_sql()
SQL = {
    "rank_city_topn": with_(RANKED, f"SELECT {', '.join(ITEM_COLS)} FROM items"),
    "shop_signals": with_(SIGNALS, f"SELECT {', '.join(SIGNAL_COLS)} FROM signals"),
    "shop_features": with_(SCORED, f"SELECT {', '.join(F_COLS)} FROM marked"),
    "shop_penalties": with_(SCORED, f"SELECT {', '.join(P_COLS)} FROM marked"),
    "shop_quality_score": with_(SCORED, "SELECT city, shop_key, base_score, time_decay, confidence, multiplier, score FROM scored"),
    "hard_rule_reason": with_(SCORED, "SELECT city, shop_key, exclude_reason, excluded FROM scored"),
    "time_decay": with_(SCORED, "SELECT city, shop_key, time_decay FROM scored"),
    "tenure_bonus": with_(SCORED, "SELECT city, shop_key, tenure_bonus FROM scored"),
    "burst_flag": with_(f"{FACTS}, {BURSTS}", "SELECT * FROM bursts"),
    "bayes_smooth": with_(SMOOTHED, "SELECT city, shop_key, score, smoothed FROM smoothed"),
    "liveness_tenure_adjust": with_(ADJUSTED, "SELECT city, shop_key, smoothed, liveness, final FROM adjusted"),
    "display_score": with_(RANKED, "SELECT city, shop_id, rank, display_score FROM items"),
    "rank_reasons": with_(SIGNALS, reasons_sql()),
    "rank_enriched": with_(
        f"{RANKED}, {WORDS_CTE.format(c='praise')}, {WORDS_CTE.format(c='complaints')}, {SOURCES_CTE}, lasts AS (SELECT shop_id, strftime(max(seen_at), '%Y-%m-%d') AS last_mentioned_at, arg_min_null(address_text, mid) AS first_address FROM mentions WHERE shop_id IS NOT NULL GROUP BY shop_id), ns AS (SELECT shop_id, CAST(count(*) AS INTEGER) AS n_sources FROM sources GROUP BY shop_id)",
        "SELECT city, rank, shop_id, coalesce(nullif(address, ''), first_address) AS address, p.words AS praise, c.words AS complaints, n_sources, last_mentioned_at FROM items LEFT JOIN praise_words p USING (shop_id) LEFT JOIN complaints_words c USING (shop_id) LEFT JOIN ns USING (shop_id) LEFT JOIN lasts USING (shop_id)",
    ),
    "ablation_variants": with_(VARIANTS, "SELECT * FROM variants"),
    "ablation_spearman": with_(VARIANTS + SPEARMAN_SQL.split("\nSELECT variant, round")[0], "SELECT variant, round" + SPEARMAN_SQL.split("\nSELECT variant, round")[1]),
    "topk_keywords_per_shop": with_(f"{ROLES_SQL}, {WORDS_CTE.format(c='praise')}", "SELECT shop_id, words FROM praise_words"),
    "sources_first_n": with_(f"{ROLES_SQL}, {SOURCES_CTE}", "SELECT shop_id, i, content_id, platform, source_url, nullif(substr(trim(evidence), 1, 120), '') AS excerpt, strftime(published_at, '%Y-%m-%d') AS published_at FROM sources"),
    "rank_filter_page": with_(RANKED, "SELECT city, rank, shop_id, name, cuisine, avg_price FROM (SELECT i.city, rank, shop_id, i.name, cuisine, i.avg_price, row_number() OVER (PARTITION BY i.city ORDER BY rank) AS place FROM items i JOIN shops USING (shop_id) WHERE contains(cuisine, 'ECON') AND i.avg_price BETWEEN 50 AND 120) WHERE place <= 5"),
    "rank_days_filter": with_(
        f"{RANKED}, recent AS (SELECT shop_id FROM shops JOIN (SELECT shop_id, max(seen_at) AS last FROM mentions GROUP BY shop_id) USING (shop_id) WHERE status = 'active' AND last >= {NOW} - INTERVAL 120 DAY)",
        "SELECT city, row_number() OVER (PARTITION BY city ORDER BY rank) AS rank, shop_id, name, final FROM items WHERE shop_id IN (SELECT shop_id FROM recent)",
    ),
    "rank_envelope": with_(RANKED, "SELECT i.city, count(*) FILTER (WHERE area = 'A3') AS total, count(*) AS city_rank_count, CASE WHEN count(*) >= 30 THEN 'deep' WHEN count(*) >= 5 THEN 'initial' ELSE 'collecting' END AS tier FROM items i JOIN shops USING (shop_id) GROUP BY i.city"),
    "city_list_full_outer": with_(
        f"{RANKED}, cities AS (SELECT DISTINCT city FROM shops UNION SELECT city FROM mentions), a AS (SELECT city, count(*) AS n FROM shops GROUP BY city), b AS (SELECT city, count(DISTINCT content_id) AS n FROM mentions GROUP BY city), c AS (SELECT city, count(*) AS n FROM items GROUP BY city)",
        "SELECT city, coalesce(a.n, 0) AS restaurant_count, coalesce(b.n, 0) AS content_count, coalesce(c.n, 0) AS rank_count, coalesce(c.n, 0) > 0 AS has_rank, CASE WHEN coalesce(c.n, 0) >= 30 THEN 'deep' WHEN coalesce(c.n, 0) >= 5 THEN 'initial' ELSE 'collecting' END AS tier FROM cities LEFT JOIN a USING (city) LEFT JOIN b USING (city) LEFT JOIN c USING (city)",
    ),
    "city_maturity": "SELECT p_brand AS city, count(*) AS n, CASE WHEN count(*) >= 30 THEN 'deep' WHEN count(*) >= 5 THEN 'initial' ELSE 'collecting' END AS tier FROM part GROUP BY p_brand",
    "latest_snapshot_by_time": with_(SNAPSHOTS_SQL, "SELECT city, max_by(snapshot_id, {'g': generated_at, 's': snapshot_id}) AS snapshot_id FROM snapshots GROUP BY city"),
    "latest_snapshot_by_id": with_(SNAPSHOTS_SQL, "SELECT city, max(snapshot_id) AS snapshot_id FROM snapshots GROUP BY city"),
}
