"""The engine's roles, bound to the driver's tables, once as DataFrames and once as SQL.

Order of mentions: ``mid``, a number made of the line's own keys; no global numbering is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.functions.text import shop_norm
from savora.params import TABLES
from savora.sources.store import stored

PRAISE = ("fresh", "locals only", "viral", "hidden lane", "generous", "smoky", "crisp", "tender")
COMPLAINTS = ("slow", "plain room", "dirty", "noisy", "pricey", "far")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with its times as UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def pick(words: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n.cast("long") % len(words) + 1).cast("int"))


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        key.alias("shop_id"), F.col("p_name").alias("name"), shop_norm(F.col("p_name"), TABLES).alias("name_norm"), F.col("p_brand").alias("city"), F.col("p_type").alias("cuisine"),
        F.concat(F.lit("A"), (size % 10).cast("string")).alias("area"), F.when(key % 29 != 0, F.col("p_retailprice") - 850).alias("avg_price"),
        F.concat(F.when(size % 25 == 0, "Mall ").otherwise("Lane "), size.cast("string")).alias("address"),
        F.when(key % 19 == 0, "suspect").when(key % 31 == 0, "closed").otherwise("active").alias("liveness"),
        (key % 41 == 0).alias("is_chain"), F.when(key % 43 == 0, "merged").otherwise("active").alias("status"), F.lit(None).cast("string").alias("map_category"),
    )


SHOPS_SQL = """shops AS (
  SELECT p_partkey AS shop_id, p_name AS name,
    CASE WHEN ends_with(n0, ' gear') AND length(n0) > 5 THEN substr(n0, 1, length(n0) - 5) ELSE n0 END AS name_norm, p_brand AS city, p_type AS cuisine,
    'A' || CAST(p_size % 10 AS VARCHAR) AS area, CASE WHEN p_partkey % 29 <> 0 THEN p_retailprice - 850 END AS avg_price,
    CASE WHEN p_size % 25 = 0 THEN 'Mall ' ELSE 'Lane ' END || CAST(p_size AS VARCHAR) AS address,
    CASE WHEN p_partkey % 19 = 0 THEN 'suspect' WHEN p_partkey % 31 = 0 THEN 'closed' ELSE 'active' END AS liveness,
    p_partkey % 41 = 0 AS is_chain, CASE WHEN p_partkey % 43 = 0 THEN 'merged' ELSE 'active' END AS status
  FROM (SELECT *, CASE WHEN starts_with(p_name, 'old ') AND length(p_name) > 4 THEN substr(p_name, 5) WHEN starts_with(p_name, 'hot ') AND length(p_name) > 4 THEN substr(p_name, 5) ELSE p_name END AS n0 FROM part)
)"""


def mentions(spark: SparkSession, sf_dir: str, parts: bool = False, once: bool = False) -> DataFrame:
    """once: the six tables are joined and kept, for plans that read them several times. What is kept is narrow: texts and lists are made where they are read.

    A part's lines then lie together, mostly, so that what is counted for a shop is small before it is shuffled.
    """
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    part = part.withColumn("name_norm", shop_norm(F.col("p_name"), TABLES))  # once a part, not once a line
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    author = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("n_regionkey").cast("string")).alias("author_city"))
    content = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").cast("string").alias("content_city"))
    # small rows first: orders meet their authors, lines their supplier, before lines and orders meet; what has all columns is shuffled by part only
    heads = orders.join(author, F.col("o_custkey") == F.col("c_custkey"), "left")
    met = line.join(content, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = (met.hint("rebalance", "l_partkey") if once else met).join(part, F.col("l_partkey") == F.col("p_partkey"))
    lines = joined.select(
        F.col("l_orderkey").alias("content_id"), "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        "o_orderstatus", "o_orderdate", "o_orderpriority", "p_name", "name_norm", "p_brand", "p_size", "author_city", "content_city",
    )
    if once:
        lines = stored(lines, "mentions")
    mid = (F.col("content_id") * 100 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey")
    published = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    return lines.select(
        mid.alias("mid"), F.when(F.col("l_suppkey") % 37 != 0, F.col("l_partkey")).alias("shop_id"), F.col("p_name").alias("shop_name"), "name_norm", F.col("p_brand").alias("city"),
        F.col("o_orderpriority").alias("platform"), F.when(number % 3 != 0, F.concat(F.lit("u"), F.col("content_id").cast("string"))).alias("source_url"), "content_id",
        published.alias("published_at"), F.col("l_shipdate").alias("crawled_at"), F.coalesce(published, F.col("l_shipdate")).alias("seen_at"), published.isNotNull().alias("at_is_published"),
        (F.col("l_discount") >= 0.09).alias("low_trust"), F.when(F.col("l_tax") >= 0.08, "neutral").when(flag == "N", "positive").when(flag == "R", "mixed").otherwise("negative").alias("sentiment"),
        (F.col("l_linestatus") == "O").alias("is_recommendation"), F.array(pick(PRAISE, F.col("l_quantity")), pick(PRAISE, number)).alias("praise"),
        F.when(flag != "N", F.array(pick(COMPLAINTS, F.col("l_suppkey")))).otherwise(F.array().cast("array<string>")).alias("complaints"),
        F.when(number % 4 != 0, F.concat(F.lit("note "), pick(PRAISE, F.col("content_id")))).alias("evidence"), "author_city", "content_city",
        F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("Lane "), F.col("p_size").cast("string"))).alias("address_text"),
        (0.5 + F.col("l_discount") * 5).alias("confidence"), *([F.col("l_partkey").alias("part_id")] if parts else []),
    )


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions without a shop. Lines that differ in their part only share mid, so here the part is in it: mid * 10^12 + part, a decimal."""
    rows = mentions(spark, sf_dir, parts=True).where("shop_id is null").dropDuplicates()
    return rows.withColumn("mid", (F.col("mid").cast("decimal(20,0)") * F.lit(10**12).cast("decimal(13,0)") + F.col("part_id")).cast("decimal(38,0)")).drop("part_id")


def sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


MENTIONS_SQL = f"""mentions AS (
  SELECT (l_orderkey * 100 + l_linenumber) * 1000000 + l_suppkey AS mid, CASE WHEN l_suppkey % 37 <> 0 THEN l_partkey END AS shop_id, p_name AS shop_name, s.name_norm, p_brand AS city,
    o_orderpriority AS platform, CASE WHEN l_linenumber % 3 <> 0 THEN 'u' || CAST(l_orderkey AS VARCHAR) END AS source_url, l_orderkey AS content_id,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS published_at, l_shipdate AS crawled_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate ELSE l_shipdate END AS seen_at, o_orderstatus <> 'P' AS at_is_published,
    l_discount >= 0.09 AS low_trust, CASE WHEN l_tax >= 0.08 THEN 'neutral' WHEN l_returnflag = 'N' THEN 'positive' WHEN l_returnflag = 'R' THEN 'mixed' ELSE 'negative' END AS sentiment,
    l_linestatus = 'O' AS is_recommendation, [{sql_list(PRAISE)}[CAST(l_quantity AS BIGINT) % {len(PRAISE)} + 1], {sql_list(PRAISE)}[l_linenumber % {len(PRAISE)} + 1]] AS praise,
    CASE WHEN l_returnflag <> 'N' THEN [{sql_list(COMPLAINTS)}[l_suppkey % {len(COMPLAINTS)} + 1]] ELSE CAST([] AS VARCHAR[]) END AS complaints,
    CASE WHEN l_linenumber % 4 <> 0 THEN 'note ' || {sql_list(PRAISE)}[l_orderkey % {len(PRAISE)} + 1] END AS evidence,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(cn.n_regionkey AS VARCHAR) END AS author_city, CAST(sn.n_regionkey AS VARCHAR) AS content_city,
    CASE WHEN l_suppkey % 5 <> 0 THEN 'Lane ' || CAST(p_size AS VARCHAR) END AS address_text, 0.5 + l_discount * 5 AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN shops s ON s.shop_id = p_partkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
)"""
ROLES_SQL = f"{SHOPS_SQL}, {MENTIONS_SQL}"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour events: event_id, action, session_key, user_id, created_at, value."""
    session = F.when(F.get_json_object("props", "$.k").cast("long") % 10 != 0, F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("action"), session.alias("session_key"), "user_id", F.col("ts").alias("created_at"), "value")


TRACKS_SQL = """tracks AS (
  SELECT event_id, event_type AS action, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS session_key, user_id, ts AS created_at, value FROM events
)"""
