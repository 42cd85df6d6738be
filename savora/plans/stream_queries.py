"""Streaming analogues as registered queries: the same operations over the whole table, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from savora.operators import alerts
from savora.plans.analytics_queries import LIMIT_MINUTES, LIMIT_MOST, RATE_LIMIT_SQL
from savora.plans.bindings import TRACKS_SQL, tracks
from savora.plans.ranking_queries import with_
from savora.sources.store import work_path
from savora.streaming import jobs, states

DAY = 24 * 60


def daily(s, d):
    return jobs.daily_actions(tracks(s, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "action", "n")


def sliding(s, d):
    return jobs.sliding_counts(tracks(s, d)).select(F.date_format("upto", "yyyy-MM-dd HH:mm").alias("upto"), "n")


def through(s, d, machine, **columns):
    """The events as a stream through a state machine, in one batch; what timers made is left out."""
    session = states.state_session(s)
    shape = session.read.parquet(f"{d}/events.parquet").schema
    rows = session.readStream.schema(shape).parquet(f"{d}/events.parquet*").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), *[c.alias(n) for n, c in columns.items()])
    out, log = work_path(s, "decisions"), work_path(s, "decisions-log")
    decided = states.decided(rows.withWatermark("at", "0 seconds"), machine)
    decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(states.OUT).parquet(out).where("seq is not null").select("key", F.col("seq").alias("event_id"), "what")


THROTTLE, BREAKER, CODES = states.LoginThrottle(5 * DAY, 5, 3 * DAY), states.Breaker(7, 10 * DAY), states.OneTimeCodes(10 * DAY, 3)


def login_throttle(s, d):
    """Events as attempts to log in, of which purchases succeed."""
    return through(s, d, THROTTLE, success=F.col("event_type") == "purchase")


def breaker_runs(s, d):
    """Events as runs of a user's source; errors are refused as often as a tenth of their value says."""
    return through(s, d, BREAKER, refused=F.when(F.col("event_type") == "error", F.floor(F.col("value") / 10)).otherwise(0).cast("int"))


def code_lifecycle(s, d):
    """Sign-ups issue a code, everything else tries one."""
    code = (F.get_json_object("props", "$.k").cast("long") % 4).cast("string")
    return through(s, d, CODES, kind=F.when(F.col("event_type") == "signup", "issue").otherwise("try"), code=code)


def limited_views(s, d):
    return through(s, d, states.SlidingLimit(LIMIT_MINUTES, LIMIT_MOST)).select(F.col("key").alias("user_id"), "event_id", (F.col("what") == "accepted").alias("accepted"))


BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, float("inf"))
HOURS = 60


def hourly(s, d):
    """A counter of each kind of event, read every hour; it starts again at midnight."""
    hours = tracks(s, d).groupBy(F.col("action").alias("series"), F.date_trunc("hour", "created_at").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return hours.withColumn("value", F.sum("n").over(Window.partitionBy("series", F.to_date("at")).orderBy("at")))


def alert_increase(s, d):
    rows = alerts.held(alerts.increases(hourly(s, d), ["series"], 6 * HOURS), ["series"], F.col("increase") >= 16, 2 * HOURS)
    return rows.select("series", F.date_format("at", "yyyy-MM-dd HH").alias("hour"), "increase", "state")


def alert_quantile(s, d):
    """The 95th percentile of each day's values, as a histogram tells it."""
    each = tracks(s, d).select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "value")
    buckets = each.groupBy("day").agg(*[F.count_if(F.col("value") <= b).alias(f"b{k}") for k, b in enumerate(BOUNDS)])
    rows = buckets.select("day", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(BOUNDS)])).alias("b")).select("day", "b.*")
    return alerts.quantile(rows, ["day"], 0.95).withColumn("quantile", F.round("quantile", 6))


#: e: a user's events by n, with t in micros; one step of the recursion for each.
EVENTS_SQL = "e AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id, epoch_us(ts) AS t, event_type, value, json_extract_string(props, '$.k') AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"

QUERIES = {"events_daily_window": daily, "events_sliding_count": sliding, "login_throttle": login_throttle, "breaker_runs": breaker_runs, "code_lifecycle": code_lifecycle, "limited_views": limited_views, "alert_increase": alert_increase, "alert_quantile": alert_quantile}
SQL = {
    "events_daily_window": with_(TRACKS_SQL, "SELECT strftime(created_at, '%Y-%m-%d') AS day, action, count(*) AS n FROM tracks GROUP BY ALL"),
    "events_sliding_count": with_(TRACKS_SQL, "SELECT strftime(date_trunc('hour', created_at) + to_hours(CAST(h AS INTEGER)), '%Y-%m-%d %H:%M') AS upto, count(*) AS n FROM tracks, range(1, 25) r(h) GROUP BY 1"),
    "limited_views": RATE_LIMIT_SQL,
    "login_throttle": with_(
        EVENTS_SQL,
        f""", w AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS fails, CAST(0 AS BIGINT) AS until, '' AS what FROM e
        UNION ALL SELECT k, n, event_id, CASE WHEN hit OR (ok AND NOT held) THEN [] WHEN held THEN fails ELSE now END, CASE WHEN held THEN until WHEN hit THEN t + {THROTTLE.lock} ELSE 0 END,
          CASE WHEN held THEN 'locked' WHEN ok THEN 'succeeded' WHEN hit THEN 'locking' ELSE 'failed' END FROM (
          SELECT *, NOT held AND NOT ok AND len(now) >= {THROTTLE.most} AS hit FROM (
            SELECT e.k, e.n, e.event_id, e.t, e.event_type = 'purchase' AS ok, w.fails, w.until, e.t < w.until AS held, list_append(list_filter(w.fails, lambda x: e.t - x <= {THROTTLE.span}), e.t) AS now
            FROM w JOIN e ON e.k IS NOT DISTINCT FROM w.k AND e.n = w.n + 1)))
        SELECT k AS key, event_id, what FROM w WHERE n > 0""",
        recursive=True,
    ),
    "breaker_runs": with_(
        EVENTS_SQL,
        f""", w AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS until, '' AS what FROM e
        UNION ALL SELECT e.k, e.n, e.event_id, CASE WHEN e.t < w.until THEN w.until WHEN e.event_type = 'error' AND floor(e.value / 10) >= {BREAKER.limit} THEN e.t + {BREAKER.span} ELSE 0 END,
          CASE WHEN e.t < w.until THEN 'held' WHEN e.event_type = 'error' AND floor(e.value / 10) >= {BREAKER.limit} THEN 'tripped' ELSE 'ran' END
        FROM w JOIN e ON e.k IS NOT DISTINCT FROM w.k AND e.n = w.n + 1)
        SELECT k AS key, event_id, what FROM w WHERE n > 0""",
        recursive=True,
    ),
    "code_lifecycle": with_(
        EVENTS_SQL,
        f""", w AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS STRUCT(c VARCHAR, until BIGINT, f INTEGER)[]) AS codes, '' AS what FROM e
        UNION ALL SELECT k, n, event_id, CASE WHEN issue THEN list_append(open, {{'c': code, 'until': t + {CODES.span}, 'f': 0}}) WHEN pos > 0 THEN open[:pos - 1] || open[pos + 1:] WHEN len(open) = 0 THEN open
            WHEN open[-1].f + 1 >= {CODES.attempts} THEN open[:-2] ELSE list_append(open[:-2], {{'c': open[-1].c, 'until': open[-1].until, 'f': open[-1].f + 1}}) END,
          CASE WHEN issue THEN 'issued' WHEN pos > 0 AND open[pos].f < {CODES.attempts} THEN 'passed' ELSE 'refused' END FROM (
          SELECT *, CASE WHEN list_contains(names, code) THEN len(open) - list_position(list_reverse(names), code) + 1 ELSE 0 END AS pos FROM (
            SELECT *, list_transform(open, lambda c: c.c) AS names FROM (
              SELECT e.k, e.n, e.event_id, e.t, e.event_type = 'signup' AS issue, CAST(CAST(e.x AS BIGINT) % 4 AS VARCHAR) AS code, list_filter(w.codes, lambda c: c.until > e.t) AS open
              FROM w JOIN e ON e.k IS NOT DISTINCT FROM w.k AND e.n = w.n + 1))))
        SELECT k AS key, event_id, what FROM w WHERE n > 0""",
        recursive=True,
    ),
    "alert_increase": with_(
        TRACKS_SQL,
        """, h AS (SELECT action AS series, date_trunc('hour', created_at) AS ts, count(*) AS n FROM tracks GROUP BY ALL
        ), c AS (SELECT *, sum(n) OVER (PARTITION BY series, CAST(ts AS DATE) ORDER BY ts) AS value FROM h
        ), s AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts) AS b FROM c
        ), i AS (SELECT *, CAST(sum(CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END) OVER (PARTITION BY series ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS increase FROM s
        ), g AS (SELECT *, count(*) FILTER (WHERE increase < 16) OVER (PARTITION BY series ORDER BY ts) AS island FROM i
        ), f AS (SELECT *, min(ts) FILTER (WHERE increase >= 16) OVER (PARTITION BY series, island ORDER BY ts) AS since FROM g)
        SELECT series, strftime(ts, '%Y-%m-%d %H') AS hour, increase, CASE WHEN increase < 16 THEN 'inactive' WHEN epoch_us(ts) - epoch_us(since) >= 7200000000 THEN 'firing' ELSE 'pending' END AS state FROM f""",
    ),
    "alert_quantile": with_(
        TRACKS_SQL,
        f""", b AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, le, count(*) FILTER (WHERE value <= le) AS n FROM tracks, (SELECT unnest([{", ".join("'inf'::DOUBLE" if b == float("inf") else repr(b) + "::DOUBLE" for b in BOUNDS)}]) AS le) GROUP BY ALL
        ), p AS (SELECT *, lag(le) OVER w AS low, coalesce(lag(n) OVER w, 0) AS under, max(n) OVER (PARTITION BY day) AS total FROM b WINDOW w AS (PARTITION BY day ORDER BY le))
        SELECT day, round(min_by(CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0.0) + (le - coalesce(low, 0.0)) * (0.95 * total - under) / (n - under) END, le) FILTER (WHERE n >= 0.95 * total), 6) AS quantile FROM p GROUP BY day""",
    ),
}
