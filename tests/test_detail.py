"""The detail page counts a shop's mentions once, and without sorting them; the rows stay those of a shop's own facts."""

import duckdb
from pyspark.sql import functions as F

from savora.operators import ranking, scoring
from savora.params import TABLES as P
from savora.plans import catalogue
from savora.plans.bindings import mentions, shops
from tests.test_catalogue import DIR, TABLES, table


def test_counted_once(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = catalogue.QUERIES["shop_detail"](spark, DIR)
    assert "AS _source#" not in got._jdf.queryExecution().optimizedPlan().toString()  # of the signals, which lie there already
    assert table(got.toPandas()) == table(con.execute(catalogue.SQL["shop_detail"]).df())


def test_numbers_need_no_sort(spark):
    m, own = mentions(spark, DIR), shops(spark, DIR)
    plan = scoring.signals(scoring.keyed(m), own, P)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "SortAggregate" in x and "at_is_published" in x]


def test_shops_mentioned_elsewhere(spark):
    m, own = mentions(spark, DIR), shops(spark, DIR)
    moved = m.withColumn("city", F.when(F.col("shop_id") % 7 == 0, F.when(F.col("content_id") % 2 == 0, "Brand#99")).when(F.col("shop_id") % 7 == 1, "Brand#98").otherwise(F.col("city")))
    found = scoring.signals(scoring.keyed(moved), own, P)
    got, want = scoring.own_signals(found, moved, own, P), scoring.signals(scoring.own_facts(moved, own), own, P)
    assert table(got.toPandas()) == table(want.toPandas()) and got.count() > 100


def test_words_and_sources_of_repeated_mentions(spark):
    rows = [(1, 5, 7, ["b", "a"]), (1, 5, 7, ["b", "a"]), (1, 6, 8, ["a", "c", "b"]), (1, 2, 8, ["d"]), (2, 1, 1, ["x"])]
    m = spark.createDataFrame(rows, "shop_id long, mid long, content_id long, praise array<string>").selectExpr("*", "'p' AS platform", "'u' AS source_url", "'e' AS evidence", "current_timestamp() AS published_at")
    assert {r.shop_id: r.praise for r in ranking.top_words(m, "praise", 3).collect()} == {1: ["b", "a", "d"], 2: ["x"]}
    assert sorted((r.shop_id, r.i, r.content_id) for r in ranking.first_sources(m, 10).collect()) == [(1, 1, 8), (1, 2, 7), (2, 1, 1)]
