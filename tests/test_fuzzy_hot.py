"""Shops of one name and address count without being joined to each mention."""

from pyspark.sql import functions as F

from savora.operators import resolve
from savora.params import TABLES as P
from tests.test_pairs import hot


def test_many_mentions_of_a_name_that_many_shops_have(spark):
    shops, n = hot(spark, 200_000), 20_000
    names = spark.range(n).select(F.col("id").alias("mid"), F.lit("c").alias("city"), F.lit("rings").alias("name_norm"), F.lit("Lane 1").alias("address_text"))
    got = resolve.fuzzy_matches(names, shops, P).groupBy("shop_id", "ties", F.round("score", 9).alias("score")).count().collect()
    assert [tuple(r) for r in got] == [(0, 200_000, 0.93, n)]
    made = resolve.decisions(resolve.fuzzy_matches(names, shops, P), P, names).groupBy("action", "reason", "shop_id").count().collect()
    assert [tuple(r) for r in made] == [("review", "multiple candidates", 0, n)]
