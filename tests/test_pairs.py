"""Pairs of shops: hot groups are counted or expanded in pieces, and give what all pairs give."""

import random

import pytest
from pyspark.sql import functions as F

from savora.operators import quality
from savora.params import TABLES as P
from tests.test_similarity import similarity, tokens

SHOPS = "shop_id long, city string, area string, name_norm string, address string, status string"
ADDRESSES = ["Lane 1", "Lane 12", "Lane 13", "Mall 50", "", None]


def overlap(a, b):
    x, y = tokens(a), tokens(b)
    return len(x & y) / len(x | y) if x and y else None


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(k, rng.choice("cd"), rng.choice("AB"), rng.choice(["blue ring", "blue rings", "old plate", "", f"n{k % 40}"]), rng.choice(ADDRESSES), "merged" if k % 11 == 0 else "active") for k in range(300)]
    return out + [(900, None, "A", "x", "Lane 1", "active"), (901, None, "A", "x", "Lane 1", "active"), (902, "c", "A", "twin", "Lane 1", "active"), (903, "c", "B", "twin", "Mall 50", "active")]


def pairs(rows, block):
    live = [r for r in rows if r[5] == "active" and all(r[k] is not None for k in block)]
    return [(a, b) for a in live for b in live if a[0] < b[0] and all(a[k] == b[k] for k in block)]


def test_verdicts_equal_all_pairs(spark, rows):
    met = {}
    for a, b in pairs(rows, (1, 3)):
        met.setdefault((a[1], a[3]), []).append(overlap(a[4], b[4]))
    judge = lambda xs: "same" if all(x is not None and x >= 0.5 for x in xs) else "branches" if all(x is not None and x < 0.3 for x in xs) else "unclear"
    got = {(r.city, r.name_norm): (r.pairs, r.verdict) for r in quality.group_verdicts(spark.createDataFrame(rows, SHOPS)).collect()}
    assert got == {k: (len(xs), judge(xs)) for k, xs in met.items()} and len({v for _, v in got.values()}) == 3


def hot(spark, n):
    return spark.range(n).select(F.col("id").alias("shop_id"), F.lit("c").alias("city"), F.lit("A").alias("area"), F.lit("ring").alias("name_norm"), F.lit("Lane 1").alias("address"), F.lit("active").alias("status"))


def test_a_hot_name_is_not_paired(spark):
    n = 3_000_000  # 4.5 * 10^12 pairs
    assert [tuple(r) for r in quality.group_verdicts(hot(spark, n)).collect()] == [("c", "ring", n * (n - 1) // 2, "same")]


def test_duplicates_are_counted_without_pairs(spark, rows):
    frame = spark.createDataFrame(rows, SHOPS)
    want = {}
    for a, b in pairs(rows, (1, 2)):
        if (overlap(a[4], b[4]) or 0) >= 0.5:
            want[a[1]] = want.get(a[1], 0) + 1
    assert {r.city: r.pairs for r in quality.duplicates_by_address(frame, 0.5).collect()} == want
    n = 3_000_000
    assert [tuple(r) for r in quality.duplicate_rate(quality.duplicates_by_address(hot(spark, n), 0.99), hot(spark, n)).where("city is not null").select("pairs", "shops").collect()] == [(n * (n - 1) // 2, n)]


def test_pairs_by_address_equal_all_pairs(spark, rows):
    want = {(a[1], a[0], b[0], round(s, 6)) for a, b in pairs(rows, (1, 2)) if (s := overlap(a[4], b[4])) is not None and s >= 0.5}
    got = [tuple(r) for r in quality.duplicate_pairs_by_address(spark.createDataFrame(rows, SHOPS), 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_address_is_expanded_by_several_tasks(spark):
    n = 2000
    found = quality.duplicate_pairs_by_address(hot(spark, n), 0.5)
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == n * (n - 1) // 2 and len(tasks) > 8 and max(r["count"] for r in tasks) < n * n / 8


def most_expanded(found):
    """Rows that the largest explode of the plan makes when it runs."""
    run = found._jdf.queryExecution()
    run.toRdd().count()
    todo, most = [run.executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if node.nodeName() == "Generate":
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_a_pair_of_one_address_is_made_once(spark):
    n = 2000
    assert n * (n - 1) // 2 <= most_expanded(quality.duplicate_pairs_by_address(hot(spark, n), 0.5)) < 0.65 * n * n


def test_ids_that_are_missing_or_there_twice(spark):
    rows = [(k if k % 7 else None, "c", "A", "x", f"Lane 1{k % 3}", "active") for k in range(40)] + [(5, "c", "A", "x", "Lane 1", "active"), (5, "c", "A", "x", "Lane 12", "active"), (None, "c", "A", "x", "Mall 50", "active")]
    want = sorted(("c", a[0], b[0], round(overlap(a[4], b[4]), 6)) for a in rows for b in rows if a[0] and b[0] and a[0] < b[0] and overlap(a[4], b[4]) >= 0.5)
    assert sorted(tuple(r) for r in quality.duplicate_pairs_by_address(spark.createDataFrame(rows, SHOPS), 0.5).collect()) == want


def test_composite_pairs_equal_all_pairs_and_are_spread(spark, rows):
    want = set()
    for a, b in pairs(rows, (1,)):
        name, place = similarity(a[3], b[3]), overlap(a[4], b[4])
        score = name if place is None else P.name_weight * name + P.address_weight * place
        if score >= 0.85 - 1e-12:
            want.add((a[1], a[0], b[0], round(score, 9)))
    got = [(r.city, r.a, r.b, round(r.similarity, 9)) for r in quality.duplicate_pairs_composite(spark.createDataFrame(rows, SHOPS), P).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    n = 2000
    tasks = quality.duplicate_pairs_composite(hot(spark, n), P).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == n * (n - 1) // 2 and len(tasks) > 8 and max(r["count"] for r in tasks) < n * n / 8
