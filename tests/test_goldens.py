"""Golden values of the scalar functions, the chunker and the scoring rules."""

import pytest
from pyspark.sql import functions as F

from savora.functions import text
from savora.operators import analytics, chunking, liveness
from savora.params import Params


def values(spark, rows, schema, column):
    return [r.x for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("x")).collect()]


def test_tokens(spark):
    assert values(spark, [("你好",), ("abcd",), ("",)], "t string", text.token_estimate(F.col("t"))) == [2, 1, 0]
    assert [chunking.tokens(t) for t in ("你好", "abcd", "")] == [2, 1, 0]


def test_half_width(spark):
    assert values(spark, [("Ａ１　ｚ．",)], "t string", text.to_half_width(F.col("t"))) == ["A1 z．"]


def test_open_hours(spark):
    rows = [("周一至周日 11:00-21:00",), ("11：00-14：00 17:00-21:00",), ("closed",)]
    got = [[tuple(r) for r in x or []] for x in values(spark, rows, "t string", text.open_ranges(F.col("t")))]
    assert got == [[(660, 1260)], [(660, 840), (1020, 1260)], []]


def test_name_similarity(spark):
    rows = [("明婷", "明婷饭店"), ("明婷", "明婷"), ("张三烤鱼", "李四火锅"), ("", "x"), ("tide", "diet")]
    got = values(spark, rows, "a string, b string", text.name_similarity(F.col("a"), F.col("b")))
    assert got[:2] == [0.9, 1.0] and got[2] < 0.5 and got[3] == 0.0 and got[4] == pytest.approx(0.25)


def test_maturity(spark):
    assert values(spark, [(n,) for n in (0, 4, 5, 29, 30)], "n int", text.maturity(F.col("n"))) == ["collecting"] * 2 + ["initial"] * 2 + ["deep"]


def test_jaccard(spark):
    rows = [(["a", "b"], ["b", "c"]), ([], ["a"])]
    got = values(spark, rows, "a array<string>, b array<string>", text.jaccard(F.col("a"), F.col("b")))
    assert got[0] == pytest.approx(1 / 3) and got[1] is None


def test_chunks():
    whole = "字" * 1000
    parts = chunking.chunks(whole, 100)
    assert len(parts) == 10 and "".join(p[0] for p in parts) == whole
    source = "第一句话。第二句话。第三句话。第四句话。"
    parts = chunking.chunks(source, 11, 5)
    assert all(source[start:end] == piece for piece, start, end, _ in parts) and len(parts) > 1
    with pytest.raises(ValueError):
        chunking.chunks("x", 0)


def test_liveness_is_idempotent(spark):
    schema = "shop_id long, poi_id string, miss_count int, liveness string, closed_at timestamp"
    rows = [(1, "a", 4, "active", None), (2, "b", 5, "active", None), (3, "c", 10, "active", None), (4, "d", 10, "relocated", None)]
    once = liveness.evaluate(spark.createDataFrame(rows, schema), Params())
    states = lambda df: [r.liveness for r in df.orderBy("shop_id").collect()]
    assert states(once) == ["active", "suspect", "closed", "relocated"] == states(liveness.evaluate(once, Params()))


def test_days_are_clamped():
    assert (analytics.clamped(999, Params()), analytics.clamped(0, Params())) == (90, 1)
