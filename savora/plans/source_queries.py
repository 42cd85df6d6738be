"""Registered queries of the sources: archives that Spark derives from the tables, read back through the readers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from savora.plans.bindings import table
from savora.sources import captured, html, robots
from savora.sources.store import work_path

PAGE, MARK = 8, datetime(1995, 6, 1)
FEED_DATE = "EEE, d MMM yyyy HH:mm:ss Z"


def search_archive(s, d) -> str:
    """Every part as a place, found by its type and by its size's remainder; the third page of some keywords is refused. All pages of a keyword are lines of one file."""
    parts = table(s, d, "part").select("p_partkey", "p_name", F.col("p_brand").alias("city"), "p_size", F.explode(F.array("p_type", F.concat(F.lit("size "), (F.col("p_size") % 3).cast("string")))).alias("keyword"))
    at = F.row_number().over(Window.partitionBy("city", "keyword").orderBy("p_partkey")) - 1
    place = F.struct(
        "at", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("Road "), F.col("p_size").cast("string"))).alias("address"),
        F.concat((F.col("p_size") / 10).cast("string"), F.lit(","), (F.col("p_partkey") % 90).cast("string")).alias("location"), F.struct(F.lit("10:00-22:00").alias("open_time")).alias("biz_ext"),
    )
    pages = parts.withColumn("at", at).withColumn("page", (F.floor(F.col("at") / PAGE) + 1).cast("int")).groupBy("city", "keyword", "page").agg(F.sort_array(F.collect_list(place)).alias("pois"))
    refused = (F.col("page") == 3) & F.startswith("keyword", F.lit("M"))
    path = work_path(s, "search-archive")
    body = F.to_json(F.struct(F.when(refused, "0").otherwise("1").alias("status"), "pois"))
    lines = pages.select(F.lit("20260101").alias("capture"), "city", "keyword", "page", F.concat(F.col("page").cast("string"), F.lit("\t"), body).alias("value"))
    lines.repartition("city", "keyword").sortWithinPartitions("capture", "city", "keyword", "page").drop("page").write.partitionBy("capture", "city", "keyword").text(path)
    return path


def captured_search(s, d):
    found = captured.searched(captured.places(s, search_archive(s, d), pageSize=PAGE))
    return found.select("city", "poi_id", "keyword", "page", "name", "address", F.round("lng", 3).alias("lng"), "lat", "open_hours")


def feed_archive(s, d) -> str:
    """Orders as entries of feeds, one for each priority and month; some are Atom, some entries have no date, link or summary."""
    key = F.col("o_orderkey").cast("string")
    tag = lambda name, value: F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))
    summary, link = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("price &lt; "), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"))), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("http://o.example/"), key))
    dated = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    rss = F.concat(F.lit("<item>"), tag("title", F.concat(F.lit("Order "), key)), tag("link", link), tag("description", summary), tag("pubDate", F.date_format(dated, FEED_DATE)), F.lit("</item>"))
    hrefs = F.coalesce(F.concat(F.lit('<link rel="self" href="x"/><link href="'), link, F.lit('"/>')), F.lit(""))
    atom = F.concat(F.lit("<entry>"), tag("title", F.concat(F.lit("Order "), key)), hrefs, tag("summary", summary), tag("updated", F.date_format(dated, "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("</entry>"))
    is_atom = F.startswith("o_orderpriority", F.lit("1"))
    rows = table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("feed"), F.date_format("o_orderdate", "yyyyMM").alias("capture"), is_atom.alias("atom"), F.when(is_atom, atom).otherwise(rss).alias("x"))
    feeds = rows.groupBy("capture", "feed", "atom").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "x"))), lambda e: e["x"]), "").alias("x"))
    whole = F.when(F.col("atom"), F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "x", F.lit("</feed>"))).otherwise(F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>")))
    path = work_path(s, "feed-archive")
    feeds.select("capture", "feed", whole.alias("value")).repartition("capture").write.partitionBy("capture", "feed").text(path)
    return path


def captured_feeds(s, d):
    items = captured.feed_items(captured.entries(s, feed_archive(s, d)), MARK)
    return items.select("feed", "raw_title", "raw_text", "source_url", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


def crawl_details(s, d):
    """A list page for each host, which links all its pages (and one of another host), followed to the pages that were captured."""
    pages = table(s, d, "pages").select("page_id", "url", "html")
    site = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    anchor = F.concat(F.lit('<a href="'), "url", F.lit('">x</a>'))
    lists = pages.groupBy(site.alias("site")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", anchor.alias("a")))), lambda x: x["a"]), "").alias("a"))
    lists = lists.select(F.concat("site", F.lit("/list")).alias("url"), F.concat(F.lit('<a href="/list">self</a><a href="http://elsewhere.example/1">x</a>'), "a").alias("html"))
    return html.details(lists, pages).select("list_url", F.col("place").cast("long").alias("place"), "source_url", "raw_text", "raw_title")


AGENT = "savora/1.0"


def robots_files(s, d):
    """A robots.txt for each host of the pages, in one of five forms by the length of its name."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    forms = ["User-agent: *\nDisallow: /en # all\nAllow: /", "User-agent: other\nDisallow: /\n\nUser-agent: Savora\nUser-agent: x\nAllow: /en\nDisallow: /", "Disallow: /\nUser-agent: *\n\nDisallow: /", "User-agent: *\nDisallow: /de\n\nuser-agent: savora\ndisallow:", "User-agent: *\nCrawl-delay: 2\nDisallow: /fr\nDisallow: /en/"]
    return table(s, d, "pages").select(host.alias("host")).where("host <> ''").distinct().withColumn("text", F.element_at(F.array(*map(F.lit, forms)), (F.char_length("host") % 5 + 1).cast("int")))


def robots_parsed(s, d):
    return robots.allowed(table(s, d, "pages").select("page_id", "url"), robots_files(s, d), AGENT).select("page_id", "allowed")


QUERIES = {
    "robots_parsed": robots_parsed,"captured_search": captured_search, "captured_feeds": captured_feeds, "crawl_details": crawl_details}
SQL = {
    "captured_search": f"""WITH k AS (SELECT p_partkey, p_name, p_brand AS city, p_size, unnest([p_type, 'size ' || CAST(p_size % 3 AS VARCHAR)]) AS keyword FROM part
      ), a AS (SELECT *, (row_number() OVER (PARTITION BY city, keyword ORDER BY p_partkey) - 1) AS pos FROM k
      ), p AS (SELECT *, CAST(pos // {PAGE} + 1 AS INTEGER) AS page FROM a WHERE pos // {PAGE} < 25 AND NOT (starts_with(keyword, 'M') AND pos // {PAGE} >= 2))
      SELECT city, 'P' || CAST(p_partkey AS VARCHAR) AS poi_id, keyword, page, p_name AS name, CASE WHEN p_size % 5 <> 0 THEN 'Road ' || CAST(p_size AS VARCHAR) END AS address,
        round(p_size / 10.0, 3)::DOUBLE AS lng, CAST(p_partkey % 90 AS DOUBLE) AS lat, '10:00-22:00' AS open_hours
      FROM p QUALIFY row_number() OVER (PARTITION BY city, p_partkey ORDER BY keyword, pos) = 1""",
    "captured_feeds": """SELECT o_orderpriority AS feed, 'Order ' || CAST(o_orderkey AS VARCHAR) AS raw_title, CASE WHEN o_orderkey % 3 <> 0 THEN 'price < ' || CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS VARCHAR) ELSE 'Order ' || CAST(o_orderkey AS VARCHAR) END AS raw_text,
      CASE WHEN o_orderkey % 4 <> 0 THEN 'http://o.example/' || CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority END AS source_url, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day
      FROM orders WHERE o_orderkey % 5 = 0 OR o_orderdate >= TIMESTAMP '1995-06-01'""",
    "crawl_details": f"""WITH t AS ({html.TEXT_SQL}), u AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site FROM pages WHERE url IS NOT NULL
      ), f AS (SELECT site, url, min(page_id) AS page_id FROM u WHERE url <> site || '/list' GROUP BY ALL
      ), p AS (SELECT f.*, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS place FROM f)
      SELECT site || '/list' AS list_url, place, p.url AS source_url, substr(text, 1, 6000) AS raw_text,
        nullif(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS raw_title
      FROM p JOIN pages q ON q.url = p.url JOIN t ON t.page_id = q.page_id WHERE text <> ''""",
    # what the five forms say for the agent, by reading them
    "robots_parsed": """WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS p FROM pages), v AS (SELECT *, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS path FROM u)
      SELECT page_id, CASE WHEN coalesce(host, '') = '' THEN FALSE ELSE CASE length(host) % 5 WHEN 0 THEN NOT starts_with(path, '/en') WHEN 1 THEN starts_with(path, '/en') WHEN 2 THEN TRUE WHEN 3 THEN TRUE ELSE NOT (starts_with(path, '/fr') OR starts_with(path, '/en/')) END END AS allowed FROM v""",
}
