"""Registered queries against their SQL in DuckDB at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from savora.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = "shop_signals display_score rank_days_filter city_list_full_outer track_daily_uv admin_overview jobs_by_day crawl_gauges liveness_replay duplicate_pairs_jaccard exact_align recommend_hot is_open_at language_gate content_dedup_hash events_sliding_count html_text html_links favourite_list trip_list pack_list shop_detail crawl_totals poi_rounds feedback_checked post_checked city_sort usage_deltas visit_sessions alias_added robots_gate display_fields alert_text rank_city_topn rank_enriched poi_upserts ingest_upserts captured_search captured_feeds crawl_details robots_parsed alert_increase alert_quantile code_checks code_lifecycle login_throttle".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) == "NaT":
        return "null"
    if isinstance(x, list | tuple) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return str([plain(y) for y in x])
    return f"{float(x):.9g}" if hasattr(x, "__float__") else str(x)


def table(df):
    return sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.to_dict("records"))


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and table(got) == table(want)


def test_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(catalogue.QUERIES) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
