"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes, confirmed by digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import set_aside

#: (action, host, path): the rules of the registered query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages plus host, path, rule (host || path of the rule that decides, else null) and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's path. The longest rule text wins; ties go
    to the longer host, then to block, then to the smaller text. Without a rule the verdict is `default`. Null urls and urls
    without :// have an empty host and path and fit no rule with a host. Each distinct url is judged once, so that repeated
    rows and hot urls cost one expansion. Only the path lengths and the numbers of host labels that some rule has are
    expanded; the rules may be of any number, as they are joined by an equality on hash prefixes and broadcast only if Spark
    finds them small. Columns of pages named like the added ones are replaced, no others clash.
    """
    pages, (url,), back = set_aside(pages, {"_url", "_u", "_best"}, url)
    r = rules.select("action", "host", "path", F.concat("host", "path").alias("rule")).where(F.col("rule").isNotNull()).dropDuplicates()
    r = r.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    labels = lambda host: F.when(host == "", 0).otherwise(F.size(F.split(host, r"\.")))
    lengths = r.agg(F.collect_set(F.length("path")).alias("_lengths"), F.collect_set(labels(F.col("host"))).alias("_counts"))
    u = pages.select(F.col(url).alias("_url")).distinct()
    u = u.withColumn("_host", url_host(F.col("_url"))).withColumn("_path", url_path(F.col("_url")))
    u = u.crossJoin(F.broadcast(lengths))  # one row: the path lengths and label counts of the rules
    suffix = lambda n: F.call_function("substring_index", F.col("_host"), F.lit("."), -n)
    u = u.withColumn("_n", labels(F.col("_host"))).withColumn("_hosts", F.transform(F.filter("_counts", lambda n: n <= F.col("_n")), suffix))
    u = u.withColumn("_paths", F.transform(F.filter("_lengths", lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n)))
    e = u.select("_url", F.explode("_hosts").alias("_h"), "_paths").select("_url", "_h", F.explode("_paths").alias("_p"))
    e = e.withColumn("_digest", F.sha2(F.concat("_h", "_p"), 256)).withColumn("short", F.substring("_digest", 1, PREFIX_HEX))
    hit = e.join(r, "short").where((F.col("_digest") == F.col("digest")) & (F.col("_h") == F.col("host")) & (F.col("_p") == F.col("path")))
    rank = F.struct(F.length("rule").alias("a"), F.length("host").alias("b"), (F.col("action") == "block").alias("c"))
    best = hit.groupBy("_url").agg(F.min_by(F.struct("rule", "action"), F.struct((-rank["a"]).alias("a"), (-rank["b"]).alias("b"), (~rank["c"]).alias("c"), F.col("rule").alias("d"))).alias("_best"))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    p = pages.select(*[F.col(c) for c in keep], F.col(url).alias("_u"))
    out = p.join(best.where(F.col("_url").isNotNull()), p["_u"] == best["_url"], "left")
    return out.select(*keep, url_host(F.col("_u")).alias("host"), url_path(F.col("_u")).alias("path"), F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict")).transform(back)
