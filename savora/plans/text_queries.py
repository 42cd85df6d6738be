"""Registered queries of the text pipeline, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from savora.functions import text as tx
from savora.operators import chunking, quality
from savora.params import TABLES as P
from savora.plans.bindings import shops, table
from savora.sources import html


def docs(s, d):
    return table(s, d, "documents")


def pages(s, d):
    return table(s, d, "pages")


HITS = "list_filter([" + ", ".join(f"'{w}'" for w in P.ad_words) + "], lambda w: contains(coalesce(text, ''), w))"


def found_names(s, d, step):
    """A stand-in for extraction: the long words of each document, all or those from every other word."""
    words = F.filter(F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"[^A-Za-z]+")), lambda w: F.char_length(w) >= 14)
    return docs(s, d).select("doc_id", F.filter(words, lambda w, i: i % step == 0).alias("names"))


def name_pairs(s, d):
    """Every shop's normalised name against that of the next shop of its city."""
    w = Window.partitionBy("city").orderBy("shop_id")
    rows = shops(s, d).select("city", "shop_id", "name_norm", F.lead("shop_id").over(w).alias("next_id"), F.lead("name_norm").over(w).alias("next_norm"))
    return rows.select("shop_id", "next_id", tx.name_similarity(F.col("name_norm"), F.col("next_norm")).alias("similarity"))


QUERIES = {
    "name_similarity": name_pairs,
    "clean_text": lambda s, d: docs(s, d).select("doc_id", tx.cleaned(F.col("text"), P).alias("c")).select("doc_id", "c.text", "c.in_script", "c.low_trust"),
    "language_gate": lambda s, d: docs(s, d).select("doc_id", F.round(tx.script_ratio(F.coalesce("text", F.lit("")), P.script_class), 6).alias("ratio"), (tx.script_ratio(F.coalesce("text", F.lit("")), P.script_class) >= P.min_script_ratio).alias("in_script")),
    "ad_hits": lambda s, d: docs(s, d).select("doc_id", F.array_join(tx.word_hits(F.coalesce("text", F.lit("")), P.ad_words), ",").alias("hits")),
    "token_estimate": lambda s, d: docs(s, d).select("doc_id", tx.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens")),
    "half_width": lambda s, d: docs(s, d).select("doc_id", F.sha2(tx.to_half_width(F.coalesce("text", F.lit(""))), 256).alias("sha")),
    "content_dedup_hash": lambda s, d: docs(s, d).groupBy(tx.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")),
    "keyword_counts": lambda s, d: docs(s, d).select("doc_id", tx.count_hits(F.coalesce("text", F.lit("")), ("the", "de", "und")).alias("n")),
    "clipped": lambda s, d: docs(s, d).select("doc_id", tx.clip(F.col("text"), 40).alias("clip")),
    "chunks": lambda s, d: chunking.chunked(docs(s, d), "doc_id", "text", 256, 32).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("largest")),
    "html_text": lambda s, d: pages(s, d).select("page_id", html.html_text(F.col("html")).alias("text")),
    "html_links": lambda s, d: pages(s, d).select("page_id", F.explode(html.html_links(F.col("html"), F.col("url"))).alias("link")),
    "page_title": lambda s, d: pages(s, d).select("page_id", html.page_title(F.col("html")).alias("title")),
    "extract_precision_recall": lambda s, d: quality.precision_recall(found_names(s, d, 1), found_names(s, d, 2)),
}
SQL = {
    "language_gate": f"WITH r AS (SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) > 0 THEN CAST(length(regexp_replace(text, '[^{P.script_class}]', '', 'g')) AS DOUBLE) / length(regexp_replace(text, '\\s', '', 'g')) ELSE 0.0 END AS x FROM documents) SELECT doc_id, round(x, 6) AS ratio, x >= {P.min_script_ratio} AS in_script FROM r",
    "ad_hits": f"SELECT doc_id, array_to_string({HITS}, ',') AS hits FROM documents",
    "token_estimate": "SELECT doc_id, cjk + CAST(ceil((length(t) - cjk) / 4.0::DOUBLE) AS BIGINT) AS tokens FROM (SELECT doc_id, coalesce(text, '') AS t, length(regexp_replace(coalesce(text, ''), '[^一-鿿]', '', 'g')) AS cjk FROM documents)",
    "half_width": f"SELECT doc_id, sha256(translate(coalesce(text, ''), '{tx.FULL}', '{tx.HALF}')) AS sha FROM documents",
    "content_dedup_hash": "SELECT 'sha256:' || sha256(coalesce(text, '')) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "keyword_counts": "SELECT doc_id, " + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in ("the", "de", "und")) + " AS n FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "clipped": r"SELECT doc_id, nullif(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 40), '') AS clip FROM documents",
    "html_text": html.TEXT_SQL,
    "html_links": html.LINKS_SQL,
    "page_title": r"SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g'), '') AS title FROM pages",
    "extract_precision_recall": """WITH e AS (
        SELECT doc_id, list_filter(list_distinct_in_order, lambda w: length(w) >= 14) AS names FROM (
          SELECT doc_id, list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: list_position(ws, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_in_order FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[^A-Za-z]+') AS ws FROM documents))
      ), g AS (SELECT doc_id, names, list_filter(names, lambda w, i: (i - 1) % 2 = 0) AS got FROM e
      ), c AS (SELECT len(names) AS e, len(got) AS g, len(list_filter(names, lambda a: len(list_filter(got, lambda b: contains(a, b) OR contains(b, a))) > 0)) AS f, len(list_filter(got, lambda a: len(list_filter(names, lambda b: contains(a, b) OR contains(b, a))) > 0)) AS k FROM g)
      SELECT CAST(sum(e) AS BIGINT) AS expected, CAST(sum(g) AS BIGINT) AS got, round(CAST(sum(k) AS DOUBLE) / sum(g), 4) AS "precision", round(CAST(sum(f) AS DOUBLE) / sum(e), 4) AS recall FROM c""",
}
