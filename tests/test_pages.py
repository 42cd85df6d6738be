"""References, steps and schemes of pages, against Python's own unescape and urljoin."""

from html import unescape
from urllib.parse import urljoin

from pyspark.sql import functions as F

from savora.sources import html

BASES = ["http://h.example/a/b/c.html?q=1#f", "https://h.example", "https://h.example/a/"]
LINKS = ["x", "../x", "../../x", "../../../x", "./x", "/a/../b", "/a/./b/", "..", ".", "/..", "a/b/..", "//o.example/y", "http://o.example/../z", "HTTPS://h.example/q", "HTTP://h.example/q", "?k=2", "mailto:a@b", "x?y=../z", "é&amp;ü"]


def test_links(spark):
    rows = [(b, "".join(f'<a href="{x}">l</a>' for x in LINKS)) for b in BASES]
    got = {r.u: r.links for r in spark.createDataFrame(rows, "u string, h string").select("u", html.html_links(F.col("h"), F.col("u")).alias("links")).collect()}
    for b in BASES:
        joined = [urljoin(b, unescape(x)) for x in LINKS]
        assert got[b] == list(dict.fromkeys(x for x in joined if x.startswith(("http://", "https://"))))


def test_references(spark):
    page = "<p>caf&eacute; &#8217;x&#x2019; &copy &ampamp; &lt;b&gt; &nosuch; &amp;lt; 1 &lt 2</p><script>&eacute;</script>"
    got = spark.createDataFrame([(page,), (None,)], "h string").select(html.html_text(F.col("h"))).collect()
    assert [r[0] for r in got] == [unescape("caf&eacute; &#8217;x&#x2019; &copy &ampamp; &lt;b&gt; &nosuch; &amp;lt; 1 &lt 2"), ""]
