"""URL filters: every URL becomes host-suffix and path-prefix expressions, joined with the rules on short hash
prefixes; full digests, then the rules' whole paths, confirm the pairs, and the longest rule wins.

DataFrame functions only. Distinct URLs are expanded once, so that one very frequent URL costs one row; the
verdicts return to the pages by a join on the URL's digest. Rules are a DataFrame of any size: Spark broadcasts it
only when its measured size is under its own threshold.

A rule's key is its host and its path up to the last slash, so that URLs are cut at slashes alone; a rest of the
path after that slash is compared once the digests agree. A URL is expanded to the numbers of host labels and path
folders that occur together in the rules, and to no others, so a URL of any length yields no more rows than that. Among rules of equal length the longer host wins, then
block before allow, then the smaller text. Null or malformed URLs have an empty host and path and fit no rule;
repeated pages each get a row; rules with a null host, path or action are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_RULES = "SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS rules(host, path, action)"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_urls(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """The key with host and path of each row's URL."""
    plain = pages.select(F.col(key), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"))
    return plain.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def expressions(addresses: DataFrame, keys: DataFrame) -> DataFrame:
    """(address, host, path) to (address, host, path, digest): a row for each shape of the rules, a number of host
    labels and one of path folders, that the address has: its host's last labels and its path's first folders."""
    shapes = keys.agg(F.collect_set(F.struct("labels", "folders")).alias("shapes")).scalar()
    rows = addresses.withColumns({"shapes": shapes, "hosts": F.split("host", "[.]"), "paths": F.split("path", "/")})
    rows = rows.withColumn("shape", F.explode("shapes")).select("address", "host", "path", "hosts", "paths", "shape.labels", "shape.folders")
    rows = rows.filter((F.col("labels") <= F.size("hosts")) & (F.col("folders") < F.size("paths")))
    suffix = F.array_join(F.slice("hosts", F.size("hosts") - F.col("labels") + 1, F.col("labels")), ".")
    prefix = F.when(F.col("folders") == 0, "").otherwise(F.concat(F.array_join(F.slice("paths", F.lit(1), F.col("folders")), "/"), F.lit("/")))
    return rows.select("address", "host", "path", F.sha2(F.concat_ws("\n", suffix, prefix), 256).alias("digest"))


def rule_keys(rules: DataFrame) -> DataFrame:
    full = F.concat_ws("", "rule_host", "rule_path")
    named = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("action")).dropna().distinct()
    stem = F.regexp_extract("rule_path", r"^(.*/)?", 0)
    labels, folders = F.size(F.split("rule_host", "[.]")), F.size(F.split(stem, "/")) - 1
    digest = F.sha2(F.concat_ws("\n", "rule_host", stem), 256)
    return named.select("rule_path", "action", full.alias("rule"), F.length("rule_host").alias("host_length"), digest.alias("rule_digest"), labels.alias("labels"), folders.alias("folders"))


def verdicts(addresses: DataFrame, rules: DataFrame, prefix: int = 8) -> DataFrame:
    """The winning rule of each address (host, path) that any rule fits: address, rule, verdict."""
    short = lambda c: F.substring(c, 1, prefix)
    keys = rule_keys(rules)
    asked = expressions(addresses, keys).withColumn("short", short("digest"))
    known = keys.drop("labels", "folders").withColumn("short", short("rule_digest"))
    fits = asked.join(known, "short").filter((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    rank = F.struct((-F.length("rule")).alias("a"), (-F.col("host_length")).alias("b"), (F.col("action") != "block").alias("c"), F.col("rule").alias("rule"), F.col("action").alias("action"))
    best = fits.groupBy("address").agg(F.min(rank).alias("best"))
    return best.select("address", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule and verdict; ``default`` holds where no rule fits."""
    split = split_urls(pages).withColumn("address", F.sha2(F.concat_ws("\n", "host", "path"), 256))
    found = verdicts(split.select("address", "host", "path").distinct(), rules)
    out = split.join(found, "address", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
