"""robots.txt against Python's own parser."""

import random
from urllib.robotparser import RobotFileParser

from savora.sources import robots

AGENT = "SavoraBot/1.0 (+x)"
LINES = ["User-agent: *", "user-agent: savorabot", "User-agent: otherbot", "Disallow: /a", "Allow: /a/b", "Disallow:", "Disallow: /", "allow: /c # c", "Crawl-delay: 3", "", "# note", "Sitemap: http://x", "nonsense", "Disallow: *", "User-Agent: savora"]
PATHS = ["/", "/a", "/a/b/c", "/c?x=1", "", "/d#f"]


def test_random_files(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(0, 12))) for _ in range(300)] + ["User-agent: *\r\nDisallow: /a\r\n", "Disallow: /a\nUser-agent: *\nDisallow: /c"]
    files = spark.createDataFrame([(f"h{k}", t) for k, t in enumerate(texts)], "host string, text string")
    urls = spark.createDataFrame([(f"http://h{k}{p}",) for k in range(len(texts)) for p in PATHS] + [("ftp://h0/",), ("http://nofile/a",)], "url string")
    got = {r.url: r.allowed for r in robots.allowed(urls, files, AGENT).collect()}
    assert got.pop("ftp://h0/") is False and got.pop("http://nofile/a") is True
    for k, text in enumerate(texts):
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        parser.modified()
        for p in PATHS:
            assert got[f"http://h{k}{p}"] == parser.can_fetch(AGENT, f"http://h{k}{p}"), (text, p)
