"""URL filter: host-suffix and path-prefix expressions joined to rules on short digests.  DataFrame functions only.

Each url becomes its expressions: every suffix of its host at a dot, with every prefix of its path that ends in a
slash (and the empty one).  A rule's expression is its host with its path up to the last slash.  Expressions meet
rules by an equi-join on the first 8 hex digits of their SHA-256; a meeting counts only if the full digests agree and
the url's path starts with the rule's whole path.  Of the rules that fit, the longest (host and path) decides; block
goes before allow at equal length.

Only host suffixes of at most as many labels, and path prefixes of at most as many slashes, as some rule has can
meet a rule; those two bounds are scalar subqueries over the rules, so a very long url costs no more than a short one.

Defined results: a null url, or one without ``://``, has the empty host and path and gets the default verdict; every
input row gives a row, repeated ones too; extra columns are ignored; an empty rule table gives every url the default.
Rows of rules with a null host, path or verdict are no rules; repeated rules count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that expressions are joined on.
SHORT = 8


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, most: Column) -> Column:
    """The host's suffixes at dots, of ``most`` labels at most, and the host itself where it has no more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, most)), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def path_prefixes(path: Column, most: Column) -> Column:
    """The empty prefix and the path's prefixes that end in a slash, of ``most`` slashes at most."""
    parts = F.split(path, "/")
    n = F.least(F.size(parts) - 1, most)
    longer = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    return F.concat(F.array(F.lit("")), F.when(n > 0, longer).otherwise(F.array().cast("array<string>")))


def rule_expressions(rules: DataFrame) -> DataFrame:
    """Distinct rules with their key expression's digest."""
    whole = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"),
                         F.col("verdict").alias("r_verdict")).na.drop().distinct()
    return whole.withColumn("r_digest", F.sha2(F.concat("r_host", F.regexp_extract("r_path", r"(?s)^(.*/)?", 0)), 256)).withColumn(
        "short", F.substring("r_digest", 1, SHORT))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (host and path of the rule that decides, or null), ``verdict``."""
    own = rule_expressions(rules)
    bounds = own.agg(F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(0)).alias("labels"),
                     F.coalesce(F.max(F.size(F.split("r_path", "/")) - 1), F.lit(0)).alias("slashes"))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    urls = urls.withColumn("labels", bounds.select("labels").scalar()).withColumn("slashes", bounds.select("slashes").scalar())
    pairs = F.transform(host_suffixes(F.col("host"), F.greatest("labels", F.lit(1))),
                        lambda h: F.transform(path_prefixes(F.col("path"), F.col("slashes")), lambda p: F.concat(h, p)))
    asked = urls.select("page_id", "host", "path", "copies", F.explode(F.flatten(pairs)).alias("expression"))
    asked = asked.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    met = asked.join(own, "short", "left")
    fits = (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("length"), (F.col("r_verdict") == "block").alias("first"),
                    F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = met.groupBy("page_id", "host", "path", "copies").agg(F.max(F.when(fits, rank)).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def filter_pages(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The pages whose verdict is allow, with all their columns (verdicts are found once per distinct host and path)."""
    urls = pages.select(F.lit(0).alias("page_id"), "url")
    verdicts = judge(urls, rules, default).where("verdict = 'allow'").select(F.col("host").alias("__host"), F.col("path").alias("__path")).distinct()
    return pages.join(verdicts, (host_of(pages["url"]) == F.col("__host")) & (path_of(pages["url"]) == F.col("__path")), "left_semi")


#: The rules of the registered query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE = """
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
