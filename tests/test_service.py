"""Operators of lists, checks and pages on small tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from savora.operators import lists, service
from savora.sources import html

START = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(k, START + timedelta(minutes=m), u, s, a) for k, (m, u, s, a) in enumerate(rows)], "event_id long, at timestamp, user_id long, shop_id long, action string")


def test_lists(spark):
    df = events(spark, [(0, 1, 7, "add"), (1, 1, 7, "add"), (2, 1, 7, "visit"), (3, 1, 7, "remove"), (4, 1, 7, "remove"), (5, 1, 7, "add"), (5, 1, 8, "visit"), (6, 1, 8, "add"), (7, 1, 9, "remove")])
    assert [r.done for r in lists.outcomes(df, ["user_id", "shop_id"]).orderBy("event_id").collect()] == [True, False, True, False, True, True, False]
    held = {r.shop_id: (r.since.minute, r.status) for r in lists.trips(df, ["user_id", "shop_id"]).collect()}
    assert held == {7: (5, "planned"), 8: (6, "planned")}
    assert lists.recent(df.where("action <> 'remove'"), "user_id", "shop_id").first().recent == "8,7"


def test_code_checks(spark):
    rows = [(0, "a", "issue", "11"), (1, "a", "try", "22"), (2, "a", "try", "11"), (3, "a", "try", "11"), (0, "b", "issue", "1"), (11, "b", "try", "1"), (0, "c", "issue", "1"), *[(m, "c", "try", "9") for m in range(1, 6)], (6, "c", "try", "1"), (0, "d", "issue", "1"), (1, "d", "issue", "2"), (2, "d", "try", "1"), (3, "d", "try", "2")]
    df = spark.createDataFrame([(k, START + timedelta(minutes=m), b, kind, code) for k, (m, b, kind, code) in enumerate(rows)], "event_id long, at timestamp, mailbox string, kind string, code string")
    got = {r.event_id: r.ok for r in service.code_checks(df).collect()}
    want = [False, True, False, False, *[False] * 5, False, True, True]  # wrong, right, used; expired; five wrong ones void the code; any open code may be used
    assert [got[k] for k in sorted(got)] == want


def test_checks(spark):
    shops = spark.createDataFrame([(1,)], "shop_id long")
    rows = [("ok", "closed", 1), ("  ", "info", 1), ("x" * 501, "info", None), ("fine", "odd", None), ("fine", None, 2), (None, "label", 1)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, content string, type string, shop_id long")
    assert [(r.type, r.reject_reason) for r in service.feedback_checked(df, shops).orderBy("k").collect()] == [("closed", None), ("info", "blank"), ("info", "too long"), ("other", None), ("other", "unknown shop"), ("label", "blank")]


def test_specs_and_words(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(["Lin=https://a.b/c?d=e", " http://x.y ", "=http://x.y", "ftp://x", "nothing", "", None])], "k int, spec string")
    assert [(r.city, r.url) for r in service.page_specs(df, F.lit("all")).orderBy("k").collect()] == [("Lin", "https://a.b/c?d=e"), ("all", "http://x.y"), ("all", "http://x.y")]
    df = spark.createDataFrame([(1, "Lin", "a, b ,"), (2, " Lin ", None), (3, "Xi", None)], "k int, city_hint string, keywords string")
    assert [r.words for r in service.keywords_for(df, {"Lin": "soup,tea"}, "food").orderBy("k").collect()] == [["a", "b"], ["soup", "tea"], ["food"]]


def test_robots(spark):
    urls = spark.createDataFrame([(u,) for u in ["http://a/x", "http://a/x/y?z", "http://a", "http://b/x", "http://c/x", "http://d/x", "http://e/x", "ftp://a/x"]], "url string")
    fetched = spark.createDataFrame([("a", 200), ("b", 403), ("c", 404), ("d", 503)], "host string, code int")
    rules = spark.createDataFrame([("a", 0, True, "/x/y"), ("a", 1, False, "/x"), ("a", 2, False, "")], "host string, place int, allow boolean, path string")
    got = {r.url: r.allowed for r in service.robots_allowed(urls, fetched, rules).collect()}
    assert list(map(got.get, [r.url for r in urls.collect()])) == [False, True, True, False, True, True, True, False]


def test_html(spark):
    page = '<head><title>T</title><script>var a = "</p><a href=/no>";</script></head><!-- <a href=no> --><p>A &amp;<b>B</b> </p><a href="/x">1</a><a href=y>2</a><a href="#z">3</a><a href=\'//h/q\'>4</a><a href="mailto:a@b">5</a><a href="/x">6</a>'
    got = spark.createDataFrame([(page, "https://s.t/d/e.html?p#f"), (None, None)], "html string, url string").select(html.html_text(F.col("html")).alias("t"), html.html_links(F.col("html"), F.col("url")).alias("l")).collect()
    assert [tuple(r) for r in got] == [("T A & B 1 2 3 4 5 6", ["https://s.t/x", "https://s.t/d/y", "https://s.t/d/e.html?p#z", "https://h/q"]), ("", [])]


def test_display(spark):
    df = spark.createDataFrame([("0-30",), ("100-",), ("",)], "b string").select(service.price_band(F.col("b")).alias("x"))
    assert [tuple(r.x) for r in df.collect()] == [(0, 30), (100, None), (None, None)]
