"""URL filters: host-suffix and path-prefix expressions against a rule list.

Every distinct URL is expanded into its host suffixes times its path prefixes, both only of the sizes (labels of a host,
characters of a path) that occur among the rules, so a URL's expressions don't grow with its length. The expressions meet the rules in an equi-join on the first 32 bits of their SHA-256, the full
digest then confirms, and of the rules that fit the longest one decides. DataFrame functions only; whether the rules
are broadcast is left to Spark, which knows their measured size, and expressions never leave their URL's row count bound.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonnage.llm.common import bound

#: (host, path, verdict); fixed values
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
RULE_SCHEMA = "array<struct<host:string,path:string,verdict:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as a table whose small size Spark can see."""
    rows = json.dumps([{"host": h, "path": p, "verdict": v} for h, p, v in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), RULE_SCHEMA)))


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first `://`, A-Z lower-cased; both empty for null and for no `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    """SHA-256 of host and path, unambiguous where one ends."""
    return F.sha2(F.concat_ws(":", F.length(host).cast("string"), F.concat(host, path)), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _known(parts: list[Column]) -> Column:
    """Array of those parts that are not null."""
    return F.filter(F.array(F.lit(None).cast("string"), *parts), lambda p: p.isNotNull())


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's. The longest rule wins; of equally
    long ones that with the longer host, then a blocking one. Without a rule the verdict is `otherwise`. Null URLs have empty
    host and path; repeated pages and URLs get equal rows; rules with a null host, path or verdict are left out.
    """
    known = bound(rules, host="host", path="path", verdict="verdict").dropna().distinct()
    own = known.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict")
    own = own.withColumn("full", _digest(F.col("r_host"), F.col("r_path")))
    own = own.select(F.substring("full", 1, 8).alias("short"), F.col("full").alias("r_full"), "r_host", "r_path", "verdict")
    sizes = own.select(_labels(F.col("r_host")).alias("labels"), F.length("r_path").alias("chars")).distinct().collect()
    labels, chars = sorted({r.labels for r in sizes}), sorted({r.chars for r in sizes})

    rows = bound(pages, page_id="page_id", url="url")
    host, path = parsed(F.col("url"))
    urls = rows.select("url").distinct().filter("url is not null").select("url", host.alias("host"), path.alias("path"))
    suffixes = _known([F.when(_labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in labels])
    prefixes = _known([F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in chars])
    spread = urls.select("url", "path", F.explode(suffixes).alias("suffix")).select("url", "suffix", F.explode(prefixes).alias("prefix"))
    spread = spread.withColumn("full", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("full", 1, 8))
    met = spread.select("url", "short", "full").join(own, "short").filter("full = r_full")
    rank = F.struct(F.length(F.concat("r_host", "r_path")), F.length("r_host"), F.col("verdict") == "block")
    best = met.groupBy("url").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), rank).alias("best"))
    out = rows.join(best, "url", "left")
    return out.select("page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
