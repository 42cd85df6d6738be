"""Seeds, feeds and map results as DataFrames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savora.functions.text import strip
from savora.functions.time import instant

SEED = "source string, raw_title string, title string, raw_text string, text string, source_url string, url string, city_hint string, published_at string"
FEED_TIMES = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss zzz", "d MMM yyyy HH:mm:ss Z")
POI = "status string, pois array<struct<id: string, name: string, typecode: string, address: string, adname: string, cityname: string, location: string, tel: string, biz_ext: string, opentime2: string, open_time: string>>"


def parse_time(text: Column) -> Column:
    """ISO 8601 or one of the feeds' formats; null if none fits."""
    tidy = F.regexp_replace(strip(text), r"^\w{3}, ", "")
    mail = F.coalesce(*[F.try_to_timestamp(tidy, F.lit(f.removeprefix("EEE, "))) for f in FEED_TIMES])
    return F.coalesce(F.try_to_timestamp(strip(text)), mail)


def seeds(spark: SparkSession, path: str, default_city: str | None = None, default_source: str = "seed") -> DataFrame:
    """JSON lines, a JSON array, one object, or {"items": [...]}; rows without text are left out."""
    lines = spark.read.text(path, wholetext=True).select(strip(F.col("value")).alias("v"), F.col("_metadata.file_path").alias("file"))
    items = F.from_json("v", f"items array<struct<{', '.join(x.replace(' ', ': ') for x in SEED.split(', '))}>>")["items"]
    array = F.from_json("v", f"array<struct<{', '.join(x.replace(' ', ': ') for x in SEED.split(', '))}>>")
    each = F.transform(F.filter(F.split("v", r"\r?\n"), lambda x: strip(x) != ""), lambda x: F.from_json(x, SEED))
    whole = F.array(F.from_json("v", SEED))
    is_array, has_items = F.startswith("v", F.lit("[")), items.isNotNull()
    one = F.from_json("v", SEED)
    single = ~F.col("v").rlike(r"\}\s*\r?\n\s*\{")
    rows = lines.select("file", F.posexplode(F.when(is_array, array).when(has_items, items).when(single & one.isNotNull(), whole).otherwise(each)).alias("at", "r"))
    text = strip(F.coalesce(F.nullif("r.raw_text", F.lit("")), "r.text"))
    return rows.select(
        "file", "at", F.coalesce("r.source", F.lit(default_source)).alias("source"), F.coalesce("r.raw_title", "r.title").alias("raw_title"), text.alias("raw_text"), F.coalesce("r.source_url", "r.url").alias("source_url"),
        F.coalesce("r.city_hint", F.lit(default_city)).alias("city_hint"), parse_time(F.col("r.published_at")).alias("published_at"),
    ).where(F.coalesce("raw_text", F.lit("")) != "")


def since(rows: DataFrame, mark: datetime | None, most: int | None = None, order: tuple[str, ...] = ("file", "at")) -> DataFrame:
    """Rows without a time always pass, others from the mark on; then the first ``most`` in file order."""
    kept = rows.where(F.col("published_at").isNull() | (F.col("published_at") >= instant(mark))) if mark else rows
    return kept.orderBy(*order).limit(most) if most else kept


def high_water(rows: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    return rows.groupBy(*by).agg(F.max("published_at").alias("mark"))


def feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """RSS items (row_tag "item") or Atom entries ("entry")."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(
        "title string, description string, summary string, content string, link array<struct<_VALUE: string, _href: string, _rel: string>>, pubDate string, published string, updated string"
    ).load(path)
    links = F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    url = F.coalesce(links[0]["_href"], strip(links[0]["_VALUE"]))
    text = F.coalesce(*[F.nullif(strip(F.col(c)), F.lit("")) for c in ("description", "summary", "content", "title")])
    return df.select(strip(F.col("title")).alias("raw_title"), text.alias("raw_text"), url.alias("source_url"), F.coalesce(*[parse_time(F.col(c)) for c in ("pubDate", "published", "updated")]).alias("published_at"))


def blank(x: Column) -> Column:
    """Empty values of the map's answers are written as []."""
    return F.nullif(F.nullif(strip(x), F.lit("[]")), F.lit(""))


def poi_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each place with id and name, with the page file and its place there."""
    pages = spark.read.schema(POI).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).withColumn("file", F.col("_metadata.file_path"))
    rows = pages.select("file", F.posexplode("pois").alias("at", "p"))
    place = F.split(blank(F.col("p.location")), ",")
    return rows.select(
        "file", "at", blank(F.col("p.id")).alias("poi_id"), F.substring(blank(F.col("p.name")), 1, 128).alias("name"), blank(F.col("p.address")).alias("address"), blank(F.col("p.adname")).alias("area"), blank(F.col("p.cityname")).alias("city"),
        F.try_element_at(place, F.lit(2)).try_cast("double").alias("lat"), F.try_element_at(place, F.lit(1)).try_cast("double").alias("lng"), blank(F.col("p.tel")).alias("tel"), F.coalesce(blank(F.col("p.opentime2")), blank(F.col("p.open_time"))).alias("open_hours"),
    ).where("poi_id is not null and name is not null")


def first_of_each(rows: DataFrame, key: str = "poi_id", order: tuple[str, ...] = ("file", "at")) -> DataFrame:
    place = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(place)).where("_k = 1").drop("_k")


def source_registry(code: DataFrame, planned: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sources of code, plan and ledger in one list (each: source, status, note)."""
    out = None
    for k, df in enumerate((code, ledger, planned)):
        part = df.select("source", F.col("status").alias(f"_s{k}"), F.col("note").alias(f"_n{k}"))
        out = part if out is None else out.join(part, "source", "full")
    return out.select("source", F.coalesce("_s0", "_s1", "_s2").alias("status"), F.coalesce("_n1", "_n2", "_n0").alias("note"), F.col("_s0").isNotNull().alias("implemented"))


def retry_plan(outcomes: DataFrame, most: int = 3) -> DataFrame:
    """status, attempt of fetches: whether to try again, and after how many seconds."""
    again = (F.col("status").isin(0, 429) | (F.col("status") >= 500)) & (F.col("attempt") < most)
    return outcomes.withColumn("retry", again).withColumn("wait_s", F.when(again, F.least(F.lit(30.0), F.pow(F.lit(2.0), F.col("attempt") - 1))))


def request_gaps(requests: DataFrame, per_second: float) -> DataFrame:
    """Requests that came too soon after the one before to the same host."""
    before = F.lag("at").over(Window.partitionBy("host").orderBy("at"))
    gap = (F.unix_micros("at") - F.unix_micros(before)) / 1e6
    return requests.withColumn("gap_s", gap).withColumn("too_soon", F.coalesce(gap < 1 / per_second, F.lit(False)))


def url_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[,;\r\n]"), strip), lambda x: x != "")


def by_night(at: Column, start: int = 23, end: int = 7, zone: str = "Asia/Shanghai") -> Column:
    h = F.hour(F.from_utc_timestamp(at, zone))
    return (h >= start) | (h < end) if start > end else (h >= start) & (h < end)
