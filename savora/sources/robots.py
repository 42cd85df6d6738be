"""robots.txt: the rules that hold for an agent, parsed from the files' lines as gaps and islands.

Lines of a file are directives or blank. A group starts with a user-agent line that doesn't follow
another one; a blank line ends it. Rules after a blank line, before the next user-agent line, belong
to nobody, and a group without a rule counts for nothing. The first group that names the agent
holds, else the first one for ``*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savora.functions.text import strip

DIRECTIVE = r"(?i)^\s*(user-agent|allow|disallow|crawl-delay|request-rate)\s*:(.*)$"


def lines(files: DataFrame) -> DataFrame:
    """host, at, kind (u, r or blank), allow, value of every line that says something; files: host, text."""
    each = files.select("host", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("at", "line"))
    said = F.regexp_replace("line", "#.*$", "")
    name, value = F.lower(F.regexp_extract(said, DIRECTIVE, 1)), strip(F.regexp_extract(said, DIRECTIVE, 2))
    kind = F.when(F.col("line") == "", "blank").when(name == "user-agent", "u").when(name != "", "r")
    return each.select("host", "at", kind.alias("kind"), F.when(name.isin("allow", "disallow"), name == "allow").alias("allow"), value.alias("value")).where("kind is not null")


def rules_for(files: DataFrame, agent: str) -> DataFrame:
    """host, place, allow, path: the rules of the group that holds for the agent, in the file's order."""
    order = Window.partitionBy("host").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (F.col("kind") == "u") & ~F.lag("kind").over(order).eqNullSafe(F.lit("u"))
    marked = lines(files).select("*", starts.alias("_start"), F.count(F.when(F.col("kind") == "blank", 1)).over(upto).alias("_part"))
    grouped = marked.withColumn("group", F.count(F.when(F.col("_start"), 1)).over(upto))
    named = F.count(F.when(F.col("kind") == "u", 1)).over(Window.partitionBy("host", "_part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = grouped.withColumn("_named", named).where((F.col("kind") != "blank") & (F.col("_named") > 0))
    own = F.col("value") == "*"
    asked = F.lit(agent.partition("/")[0].lower())
    groups = whole.groupBy("host", "group").agg(F.bool_or((F.col("kind") == "u") & own).alias("any"), F.bool_or((F.col("kind") == "u") & ~own & F.contains(asked, F.lower("value"))).alias("mine"), F.bool_or(F.col("kind") == "r").alias("ruled"))
    rank = F.when(~F.col("any") & F.col("mine"), 0).when(F.col("any"), 1)
    chosen = groups.where(F.col("ruled") & rank.isNotNull()).groupBy("host").agg(F.min(F.struct(rank.alias("rank"), "group"))["group"].alias("group"))
    rules = whole.where("allow is not null").join(chosen, ["host", "group"])
    return rules.select("host", F.col("at").alias("place"), (F.col("allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("path"))


def verdict(rules: Column, path: Column) -> Column:
    """Whether a path is allowed by an array of rules (place, allow, path): the first that fits counts, and without one it is."""
    fits = F.filter(F.sort_array(rules), lambda r: F.startswith(path, r["path"]))
    return F.coalesce(F.get(fits, F.lit(0))["allow"], F.lit(True))


def allowed(urls: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """urls (url) with allowed: by the file of the url's host; hosts without a file allow everything, other schemes nothing."""
    host, path = F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1)
    rules = rules_for(files, agent).groupBy("host").agg(F.collect_list(F.struct("place", "allow", "path")).alias("_rules"))
    met = urls.withColumn("host", host).join(rules, "host", "left")
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return met.withColumn("allowed", F.when(F.col("host") == "", False).when(F.col("_rules").isNull(), True).otherwise(verdict(F.col("_rules"), rooted))).drop("_rules", "host")
