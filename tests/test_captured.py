"""Captured searches and feeds: stops, dedup and caps; batch and stream read the same rows, each capture once."""

from pathlib import Path
import json
from datetime import datetime

from savora.sources import captured

NOW = datetime(2026, 1, 2)


def write(root, capture, city, keyword, page, body):
    at = root / f"capture={capture}" / f"city={city}" / f"keyword={keyword}" / f"page={page}"
    at.mkdir(parents=True)
    (at / "part-0.txt").write_text(body if isinstance(body, str) else json.dumps(body))
    (at / "_SUCCESS").write_text("x")


def answer(*ids, status="1", **more):
    return {"status": status, "pois": [{"id": i, "name": f"n{i}", "location": "1.5,2.5", "biz_ext": {"opentime2": "", "open_time": "9-5"}, "address": [], **more} for i in ids]}


def archive(root):
    write(root, "1", "a%2Fb", "soup", 1, answer("x", "y"))
    write(root, "1", "a%2Fb", "soup", 2, answer("z"))  # short: the next isn't read
    write(root, "1", "a%2Fb", "soup", 3, answer("never", "never2"))
    write(root, "1", "a%2Fb", "tea", 1, answer("y", "t"))
    write(root, "1", "a%2Fb", "tea", 2, "broken")
    write(root, "1", "a%2Fb", "tea", 3, answer("never", "never2"))
    write(root, "1", "c", "soup", 1, answer("x", "y", status="0"))
    write(root, "1", "c", "tea", 2, answer("gap", "gap2"))
    return str(root)


def test_search(spark, tmp_path):
    path = archive(tmp_path / "s")
    rows = captured.places(spark, path, pageSize=2, keywords="tea,soup")
    assert [(r.keyword, r.page, r.poi_id) for r in rows.orderBy("keyword_at", "page", "at").collect()] == [("tea", 1, "y"), ("tea", 1, "t"), ("soup", 1, "x"), ("soup", 1, "y"), ("soup", 2, "z")]
    once = captured.searched(rows).collect()
    assert {(r.city, r.poi_id, r.keyword) for r in once} == {("a/b", "y", "tea"), ("a/b", "t", "tea"), ("a/b", "x", "soup"), ("a/b", "z", "soup")}
    assert (once[0].lng, once[0].lat, once[0].address, once[0].open_hours) == (1.5, 2.5, None, "9-5")
    assert {r.poi_id for r in captured.searched(rows, 3).collect()} == {"y", "t", "x"}
    assert captured.places(spark, path, pageSize=2, maxPages=1, keywords="soup,none").count() == 2


def test_stream_reads_each_capture_once(spark, tmp_path):
    root = tmp_path / "s"
    path, out = archive(root), str(tmp_path / "out")

    def run():
        query = captured.places(spark, path, stream=True, pageSize=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).start()
        query.processAllAvailable()
        query.stop()
        return spark.read.schema(captured.PLACES).parquet(out)

    assert sorted(map(str, run().collect())) == sorted(map(str, captured.places(spark, path, pageSize=2).collect()))
    write(root, "2", "c", "soup", 1, answer("new"))
    assert run().where("capture = '2'").count() == 1 and run().count() == captured.places(spark, path, pageSize=2).count()
    assert [r.poi_id for r in captured.places(spark, path, pageSize=2, since="1").collect()] == ["new"]


def test_places_and_entries_of_odd_answers():
    assert captured.place_of({"id": [], "name": "x"}) is None and captured.place_of({"id": 7, "name": " "}) is None
    assert captured.place_of({"id": 7, "name": "x", "location": "bad,2", "biz_ext": [], "typecode": "", "adname": " A "}) == ("7", "x", None, "A", 2.0, None, None, None)
    assert captured.entries_of(b"<rss><channel><item>") == []
    atom = b'<f:feed xmlns:f="urn:x"><f:entry><f:title>T &amp; t</f:title><f:link rel="self" href="s"/><f:link href="l"/><f:content><p>a <b>b</b></p></f:content><f:updated>u</f:updated><f:published>p</f:published></f:entry></f:feed>'
    assert captured.entries_of(atom) == [("T & t", "l", "a b", "p")]


def test_feeds(spark, tmp_path):
    root = tmp_path / "f"
    for feed, body in (("one", "<rss><channel><item><title>A</title><pubDate>Thu, 1 Jan 2026 10:00:00 +0000</pubDate></item><item><title>B</title><description>text</description><link> http://b </link><pubDate>Sat, 3 Jan 2026 10:00:00 +0800</pubDate></item><item><title>C</title></item><item><link>z</link></item></channel></rss>"), ("two", "not xml")):
        at = root / "capture=1" / f"feed={feed}"
        at.mkdir(parents=True)
        (at / "x.xml").write_text(body)
    found = captured.entries(spark, str(root))
    got = captured.feed_items(found, NOW).collect()
    assert [(r.raw_title, r.raw_text, r.source_url, str(r.published_at)) for r in got] == [("B", "text", "http://b", "2026-01-03 02:00:00"), ("C", "C", "one", "None")]
    assert [r.raw_title for r in captured.feed_items(found, None, 1).collect()] == ["A"]


def test_pages_as_lines_of_one_file(spark, tmp_path):
    """A keyword's answers in one file: read in order until one is missing, refused or short."""
    def answer(page, n, status="1"):
        return f"{page}\t" + json.dumps({"status": status, "pois": [{"id": f"P{page}-{k}", "name": "x"} for k in range(n)]})

    files = {"whole": [answer(1, 2), answer(2, 2), answer(3, 1), answer(4, 2)], "gap": [answer(1, 2), answer(3, 2)], "refused": [answer(1, 2), answer(2, 2, "0"), answer(3, 2)], "broken": [answer(1, 2), "2\t{", answer(3, 2)], "late": [answer(2, 2)], "none": []}
    for name, lines in files.items():
        folder = tmp_path / "a" / "capture=1" / "city=c" / f"keyword={name}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text("".join(f"{x}\n" for x in lines))
    got = captured.places(spark, str(tmp_path / "a"), pageSize=2).groupBy("keyword").count().collect()
    assert {r["keyword"]: r["count"] for r in got} == {"whole": 5, "gap": 2, "refused": 2, "broken": 2}


def test_an_archive_has_a_folder_for_a_keyword(spark):
    from savora.plans.source_queries import search_archive

    root = Path(search_archive(spark, "/root/testdata/sf0.001").removeprefix("file://"))
    assert not list(root.glob("**/page=*")) and len(list(root.glob("capture=*/city=*/keyword=*"))) > 50
