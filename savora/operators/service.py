"""Checks of what users send in, detail pages, crawl summaries and other small operators of the service."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savora.functions.text import is_open, open_ranges
from savora.functions.time import instant
from savora.operators.lists import moment
from savora.operators.ranking import first_sources, top_words
from savora.operators.scoring import earliest, own_facts, reasons, scored, signals
from savora.params import Params

#: Kinds of feedback; states of a crawl source that count as skipped.
FEEDBACK_TYPES = ("info", "closed", "label", "other")
SKIPPED = ("skipped", "breaker_open")


def feedback_checked(rows: DataFrame, shops: DataFrame, most: int = 500) -> DataFrame:
    """Rows (content, type, shop_id) with content trimmed, unknown types as ``other``, and reject_reason."""
    body = F.trim(F.coalesce("content", F.lit("")))
    known = shops.select("shop_id", F.lit(True).alias("_known"))
    reason = F.when(body == "", "blank").when(F.char_length(body) > most, "too long").when(F.col("shop_id").isNotNull() & F.col("_known").isNull(), "unknown shop")
    kind = F.when(F.col("type").isin(*FEEDBACK_TYPES), F.col("type")).otherwise("other")
    return rows.join(known, "shop_id", "left").withColumns({"reject_reason": reason, "type": kind, "content": body}).drop("_known")


def post_checked(rows: DataFrame, shops: DataFrame, most: int = 300, images: int = 3, prefix: str = "/uploads/") -> DataFrame:
    """Rows (content, images, shop_id) with reject_reason: blank, too long, unknown shop, too many images, bad image."""
    body = F.trim(F.coalesce("content", F.lit("")))
    known = shops.select("shop_id", F.lit(True).alias("_known"))
    reason = (
        F.when(body == "", "blank").when(F.char_length(body) > most, "too long").when(F.col("_known").isNull(), "unknown shop")
        .when(F.size("images") > images, "too many images").when(F.exists("images", lambda x: ~F.startswith(x, F.lit(prefix))), "bad image")
    )
    return rows.join(known, "shop_id", "left").withColumn("reject_reason", reason).drop("_known")


def status_changes(changes: DataFrame, key: str, legal: tuple[str, ...], start: str = "pending") -> DataFrame:
    """Updates of a row's status with the status before; illegal ones are refused and change nothing."""
    order = Window.partitionBy(key).orderBy("at", "event_id")
    return changes.where(F.col("status").isin(*legal)).withColumn("previous", F.coalesce(F.lag("status").over(order), F.lit(start)))


def code_checks(events: DataFrame, minutes: int = 10, attempts: int = 5) -> DataFrame:
    """Issued codes (kind ``issue``) and tries (``try``) of mailboxes; per try: event_id, ok.

    A try consumes the newest unused, unexpired code it equals. A try that equals none counts
    against the newest such code, which is void after ``attempts``. Each mailbox is one fold; how
    many codes and tries it may have in an hour is limited where they come in.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out, codes = [], []  # of codes: code, valid until, failures, used
        for r in rows.sort_values(["at", "event_id"]).itertuples():
            if r.kind == "issue":
                codes.append([r.code, r.at + pd.Timedelta(minutes=minutes), 0, False])
                continue
            open_ = [c for c in codes if not c[3] and c[1] > r.at]
            same = [c for c in open_ if c[0] == r.code]
            ok = bool(same) and same[-1][2] < attempts
            if same:
                same[-1][3] = True
            elif open_:
                open_[-1][2] += 1
                open_[-1][3] = open_[-1][2] >= attempts
            codes = [c for c in codes if not c[3] and c[1] > r.at]
            out.append((r.event_id, ok))
        return pd.DataFrame(out, columns=["event_id", "ok"]).astype({"event_id": "int64", "ok": "bool"})

    return events.select("mailbox", "event_id", "at", "kind", "code").groupBy("mailbox").applyInPandas(fold, "event_id long, ok boolean")


def shop_detail(shops: DataFrame, items: DataFrame, mentions: DataFrame, notices: DataFrame, p: Params, n_sources: int = 10, own: DataFrame | None = None) -> DataFrame:
    """A row for every shop: its place in the latest snapshot, else its own live score, which takes no account of its state; reasons, words, sources, dates, opening, notice.

    own: signals of the shops' own facts, where they are there already. Of shops, lat, lng and open_hours are optional; is_open is null where the hours can't be read.
    """
    aligned = mentions.where("shop_id is not null")
    figures = aligned.groupBy("shop_id").agg(
        F.count(F.lit(1)).alias("mention_count"), F.date_format(F.max("seen_at"), "yyyy-MM-dd").alias("last_mentioned_at"),
        F.date_format(F.coalesce(F.min("published_at"), F.min("crawled_at")), "yyyy-MM-dd").alias("first_mentioned_at"), F.min("published_at").isNotNull().alias("first_evidence_confident"),
    )
    addresses = earliest(aligned, ["shop_id"], "address_text").withColumnRenamed("address_text", "_address")
    scores = scored(signals(own_facts(aligned, shops), shops, p) if own is None else own, p).select("shop_id", F.col("score").alias("_live"), "exclude_reason", reasons(p).alias("reasons"))
    placed = items.select("shop_id", "city", F.col("display_score").alias("_shown"), "rank")
    sources = first_sources(mentions, n_sources).groupBy("shop_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "platform", "source_url", "excerpt", "published_at"))), lambda x: x.dropFields("i")).alias("sources"))
    more = [c for c in ("lat", "lng", "open_hours") if c in shops.columns]
    out = shops.select("shop_id", "name", "city", "area", "address", "cuisine", "avg_price", "status", "liveness", *more)
    for part in (scores, figures, addresses, sources, top_words(mentions, "praise"), top_words(mentions, "complaints"), notices.select("shop_id", F.lit(True).alias("_notice"))):
        out = out.join(part, "shop_id", "left")
    out = out.join(placed, ["shop_id", "city"], "left")
    ranges = open_ranges(F.coalesce(F.col("open_hours"), F.lit(""))) if "open_hours" in more else None
    opened = F.lit(None).cast("boolean") if ranges is None else F.when(F.size(ranges) > 0, is_open(ranges, instant(p.now)))
    none = F.array().cast("array<string>")
    return out.select(
        "shop_id", "name", "city", "area", F.coalesce(F.nullif("address", F.lit("")), "_address").alias("address"), "cuisine", "avg_price", "status", "liveness", *more, F.coalesce("_shown", "_live", F.lit(0.0)).alias("score"), "rank", "exclude_reason",
        F.coalesce("reasons", none).alias("reasons"), F.coalesce("praise", none).alias("praise"), F.coalesce("complaints", none).alias("complaints"), F.coalesce("sources", F.array()).alias("sources"), opened.alias("is_open"),
        F.coalesce("mention_count", F.lit(0)).alias("mention_count"), "last_mentioned_at", "first_mentioned_at", F.coalesce("first_evidence_confident", F.lit(False)).alias("first_evidence_confident"), F.coalesce("_notice", F.lit(False)).alias("notice"),
    )


def crawl_totals(results: DataFrame) -> DataFrame:
    """Each crawl job's totals over its sources; failed when all of them did."""
    sums = [F.sum(c).alias(c) for c in ("fetched", "new", "duplicated", "failed")]
    state = F.col("state")
    out = results.groupBy("job").agg(F.count(F.lit(1)).alias("sources"), F.count_if(state == "ok").alias("ok"), F.count_if(state.isin(*SKIPPED)).alias("skipped"), F.count_if(state == "failed").alias("_failed"), *sums)
    return out.withColumn("status", F.when(F.col("_failed") == F.col("sources"), "failed").otherwise("success")).drop("_failed")


def poi_rounds(jobs: DataFrame, newest: int = 400) -> DataFrame:
    """Rounds of the map search for each city among the newest finished crawls; a crawl without a city counts for all of them."""
    last = jobs.where("finished").orderBy(F.col("job").desc()).limit(newest)
    fine = last.where(~F.col("skipped") & F.col("map_state").isin("ok", "partial"))
    return fine.groupBy(F.coalesce("city_hint", F.lit("__global__")).alias("city")).agg(F.count(F.lit(1)).alias("rounds"))


def breaker_summary(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """The sources of the last finished crawl, and which of them the breaker stopped."""
    last = jobs.where("finished").agg(F.max("job").alias("job"))
    return results.join(F.broadcast(last), "job").select("job", "source", "state", (F.col("state") == "breaker_open").alias("tripped"))


def keywords_for(requests: DataFrame, by_city: dict[str, str], default: str) -> DataFrame:
    """Search words of each request: its own, else its city's, else the global ones; a list, blanks dropped."""
    cities = F.create_map(*[F.lit(x) for pair in by_city.items() for x in pair])
    own = F.when(F.col("keywords").isNotNull(), F.col("keywords")).otherwise(F.coalesce(cities[F.trim("city_hint")], F.lit(default)))
    return requests.withColumn("words", F.filter(F.transform(F.split(own, ","), lambda x: F.trim(x)), lambda x: x != ""))


def page_specs(specs: DataFrame, default_city: Column | None = None) -> DataFrame:
    """spec (``city=URL`` or a bare URL) to city, url; others are dropped."""
    spec = F.trim("spec")
    bare = spec.rlike("^https?://")
    url = F.when(bare, spec).otherwise(F.trim(F.expr("substr(trim(spec), instr(trim(spec), '=') + 1)")))
    city = F.when(~bare, F.nullif(F.trim(F.substring_index(spec, "=", 1)), F.lit("")))
    out = specs.select("*", F.coalesce(city, default_city if default_city is not None else F.lit(None).cast("string")).alias("city"), url.alias("url"))
    return out.where(F.col("url").rlike("^https?://") & (bare | spec.contains("=")))


def usage_deltas(snapshots: DataFrame, by: str, counters: list[str]) -> DataFrame:
    """What each run added to counters that only grow; a counter below its last value was reset and counts whole."""
    order = Window.partitionBy(by).orderBy("at", "event_id")
    delta = lambda c: F.when(F.lag(c).over(order).isNull() | (F.col(c) < F.lag(c).over(order)), F.col(c)).otherwise(F.col(c) - F.lag(c).over(order))
    return snapshots.select("*", *[delta(c).alias(f"{c}_delta") for c in counters])


def sessions(events: DataFrame, by: str, minutes: int) -> DataFrame:
    """Visits: events of a key with less than the gap between them."""
    return events.groupBy(by, F.session_window("at", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")


def moved_forward(current: DataFrame, arriving: DataFrame, key: str, column: str) -> DataFrame:
    """current with the column raised to the greatest arriving value, never lowered."""
    top = arriving.groupBy(key).agg(F.max(column).alias("_top"))
    return current.join(top, key, "left").withColumn(column, F.greatest(column, "_top")).drop("_top")


def alert_text(alerts: DataFrame, by: str) -> DataFrame:
    """A message for each group: how many alerts, then a line for each in order of time."""
    line = F.concat(F.lit("["), F.upper("status"), F.lit("] "), F.col("name"), F.coalesce(F.concat(F.lit(": "), F.col("summary")), F.lit("")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("at", "event_id", line.alias("line")))), lambda x: x["line"])
    return alerts.groupBy(by).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" alerts\n"), F.array_join(lines, "\n")).alias("message"))


def price_band(band: Column) -> Column:
    """``30-60`` to a struct of min and max; an open end is null."""
    parts = F.split(band, "-")
    return F.struct(F.try_to_number(F.nullif(parts[0], F.lit("")), F.lit("99999")).cast("int").alias("min"), F.try_to_number(F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.lit("99999")).cast("int").alias("max"))


def tenure_years(first: Column, now: Column) -> Column:
    """Whole years of 365.25 days, one at least."""
    return F.greatest(F.lit(1), F.floor((F.unix_micros(now) - F.unix_micros(first)) / F.lit(365.25 * 86_400_000_000)).cast("int"))


def percent_text(ratio: Column) -> Column:
    return F.concat(F.format_number(ratio * 100, 1), F.lit("%"))


def alias_added(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Aliases with those wanted (alias_norm, shop_id) that no shop has yet; the first request for an alias wins."""
    first = wanted.groupBy("alias_norm").agg(F.min_by("shop_id", moment()).alias("shop_id"))
    return aliases.select("alias_norm", "shop_id").unionByName(first.join(aliases, "alias_norm", "left_anti").select("alias_norm", "shop_id"))


def robots_allowed(urls: DataFrame, fetched: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) with allowed. fetched: host, code (null: no answer); rules: host, place, allow, path (of the agent's own group).

    200 goes by the rules, the first that fits; 401 and 403 forbid all; other codes below 500 allow
    all, and no answer or a server's error too. What is no http address is refused.
    """
    at = F.regexp_extract("url", "^(https?)://([^/?#]+)", 2)
    path = F.regexp_extract("url", "^https?://[^/?#]+([^#]*)", 1)
    located = urls.select("*", at.alias("host"), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)).alias("_path"))
    lists = rules.where("path <> ''").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "allow", "path"))).alias("rules"))  # one file's lines
    met = located.join(fetched, "host", "left").join(lists, "host", "left")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("_path"), r["path"])), F.lit(0))["allow"]
    allowed = F.when(F.col("host") == "", False).when(F.col("code") == 200, F.coalesce(first, F.lit(True))).when(F.col("code").isin(401, 403), False).otherwise(True)
    return met.withColumn("allowed", allowed).drop("_path", "rules")
