"""Pages as sources: text, links and titles, as column functions.

Scripts, styles and comments go first, whatever tags they hold; a tag then ends a piece of text.
All character references are decoded as HTML says.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAG = r"(?s)<[/!?a-zA-Z][^>]*>"
HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
BREAK = "\x01"


@F.pandas_udf(T.StringType())
def unescaped(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references decoded (Spark has no function for it)."""
    for batch in texts:
        yield batch.map(lambda x: unescape(x) if x is not None and "&" in x else x)


def html_text(html: Column) -> Column:
    """The pieces of text outside scripts and styles, stripped, joined by one space."""
    marked = unescaped(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, BREAK), TAG, BREAK))
    pieces = F.transform(F.split(marked, BREAK), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(pieces, lambda x: x != ""), " ")


def tidied(link: Column) -> Column:
    """An address without the steps . and .. of its path."""
    site, path, rest = (F.regexp_extract(link, r"^(https?://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    steps = F.split(path, "/")
    end = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    first = F.array(F.lit("")).cast("array<string>")
    kept = F.aggregate(F.slice(steps, 2, F.size(steps)), first, lambda done, x: F.when(x == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    return F.when(F.contains(path, F.lit("/.")), F.concat(site, F.array_join(F.concat(kept, end), "/"), rest)).otherwise(link)


def html_links(html: Column, base: Column) -> Column:
    """Absolute http(s) links, each once, in page order; relative ones by the page's address, with . and .. resolved. A scheme in capitals counts if it is the page's own."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    page = F.regexp_replace(F.coalesce(base, F.lit("")), "#.*$", "")
    site, bare, own = F.regexp_extract(page, "^(https?://[^/?]+)", 1), F.regexp_replace(page, r"\?.*$", ""), F.regexp_extract(page, "^(https?):", 1)
    folder = F.when(bare.rlike("^https?://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, "[^/]*$", ""))

    def whole(link: Column) -> Column:
        scheme = F.regexp_extract(link, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
        folded = F.when(F.lower(scheme) == own, F.concat(F.lower(scheme), F.substring(link, F.char_length(scheme) + 1, F.char_length(link)))).otherwise(link)
        return (
            F.when(scheme != "", folded).when(F.startswith(link, F.lit("//")), F.concat(own, F.lit(":"), link)).when(F.startswith(link, F.lit("/")), tidied(F.concat(site, link)))
            .when(F.startswith(link, F.lit("#")), F.concat(page, link)).when(F.startswith(link, F.lit("?")), F.concat(bare, link)).otherwise(tidied(F.concat(folder, link)))
        )

    hrefs = F.split(unescaped(F.array_join(F.regexp_extract_all(seen, F.lit(HREF), F.lit(1)), BREAK)), BREAK)
    return F.array_distinct(F.filter(F.transform(hrefs, whole), lambda x: x.rlike("^https?://[^/?#]")))


def page_title(html: Column) -> Column:
    title = F.regexp_replace(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"<[^>]+>", " "), r"(?U)^\s+|\s+$", "")
    return F.when(title != "", title)


def detail_links(links: Column, page: Column, most: int = 20) -> Column:
    """Links of the page's own host, without the page itself."""
    host = lambda u: F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1)
    return F.slice(F.filter(links, lambda u: (host(u) == host(page)) & (u != page)), 1, most)


def details(lists: DataFrame, pages: DataFrame, most_text: int = 6000) -> DataFrame:
    """The crawl from lists (url, html) to the captured pages of their own hosts that they link, in each list's order; pages without text are left out."""
    links = F.posexplode(detail_links(html_links(F.col("html"), F.col("url")), F.col("url"), 1 << 30)).alias("place", "source_url")
    texts = pages.select(F.col("url").alias("source_url"), F.substring(html_text(F.col("html")), 1, most_text).alias("raw_text"), page_title(F.col("html")).alias("raw_title")).where("raw_text <> ''")
    return lists.select(F.col("url").alias("list_url"), links).join(texts, "source_url")


#: A map of the named references, and a text with its references decoded by it (the longest known name only).
NAMES_SQL = "names AS (SELECT MAP {" + ", ".join(f"'&{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in html5.items() if chr(0) not in v) + "} AS known)"


def _sql_decoded(x: str) -> str:
    pieces = f"regexp_extract_all({x}, '&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&')"
    number = "chr(CAST(CASE WHEN starts_with(lower(r), '&#x') THEN '0x' || regexp_extract(r, '[xX]([0-9a-fA-F]+)', 1) ELSE regexp_extract(r, '([0-9]+)', 1) END AS INTEGER))"
    return f"array_to_string(list_transform({pieces}, lambda r: CASE WHEN starts_with(r, '&#') THEN {number} WHEN starts_with(r, '&') THEN coalesce(known[r], r) ELSE r END), '')"


TEXT_SQL = f"""WITH {NAMES_SQL}, m AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '{UNSEEN}', chr(1), 'g'), '{TAG}', chr(1), 'g') AS t FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(string_split({_sql_decoded("t")}, chr(1)), lambda x: regexp_replace(x, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')), lambda x: x <> ''), ' ') AS text FROM m, names"""
LINKS_SQL = f"""WITH {NAMES_SQL}, m AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '#.*$', '') AS page, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '{UNSEEN}', '', 'g'), '{HREF.replace("'", "''")}', 1)) AS h FROM pages
), n AS (SELECT page_id, page, regexp_extract(page, '^(https?://[^/?]+)', 1) AS site, regexp_replace(page, '\\?.*$', '') AS bare, regexp_extract(page, '^(https?):', 1) AS own, {_sql_decoded("h")} AS l FROM m, names
), s AS (SELECT *, regexp_extract(l, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) AS scheme FROM n
), w AS (
  SELECT page_id, scheme = '' AND NOT regexp_matches(l, '^(//|#|\\?)') AS steps, CASE WHEN scheme <> '' AND lower(scheme) = own THEN own || substr(l, length(scheme) + 1) WHEN scheme <> '' THEN l WHEN starts_with(l, '//') THEN own || ':' || l WHEN starts_with(l, '/') THEN site || l
    WHEN starts_with(l, '#') THEN page || l WHEN starts_with(l, '?') THEN bare || l WHEN regexp_matches(bare, '^https?://[^/]+$') THEN bare || '/' || l ELSE regexp_replace(bare, '[^/]*$', '') || l END AS link FROM s
), p AS (SELECT *, regexp_extract(link, '^(https?://[^/?#]*)([^?#]*)(.*)$', 1) AS a, regexp_extract(link, '^(https?://[^/?#]*)([^?#]*)(.*)$', 2) AS b, regexp_extract(link, '^(https?://[^/?#]*)([^?#]*)(.*)$', 3) AS c FROM w
), t AS (SELECT page_id, CASE WHEN steps AND contains(b, '/.') THEN a || array_to_string(list_concat(list_reduce(list_prepend([''], list_transform(string_split(b, '/')[2:], lambda x: [x])),
    lambda d, x: CASE x[1] WHEN '..' THEN CASE WHEN len(d) > 1 THEN d[:-2] ELSE d END WHEN '.' THEN d ELSE list_concat(d, x) END), CASE WHEN string_split(b, '/')[-1] IN ('.', '..') THEN [''] ELSE [] END), '/') || c ELSE link END AS link FROM p)
SELECT DISTINCT page_id, link FROM t WHERE regexp_matches(link, '^https?://[^/?#]')"""
