"""URL filters: host-suffix and path-prefix expressions matched by hash prefix, then by digest, then by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import UPPER

#: (host, path, verdict); fixed values.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Hex digits of the digest by which expressions are looked up, and the most rules whose digests are broadcast
#: (about 200 bytes a rule).
PREFIX, BROADCAST_RULES = 8, 100_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """A row for each rule with the digest of its expression; of rules with one host and path the last counts."""
    last = {(h, p): v for h, p, v in rules}
    frame = spark.createDataFrame([(h, p, v) for (h, p), v in last.items()], "r_host string, r_path string, r_verdict string")
    digest = expression(F.col("r_host"), F.col("r_path"))
    return frame.select(
        F.substring(digest, 1, PREFIX).alias("short"), digest.alias("r_digest"), "r_verdict",
        F.concat("r_host", "r_path").alias("r_rule"), (F.length("r_host") + F.length("r_path")).alias("r_len"), F.length("r_host").alias("r_host_len"),
    )


def expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_filter(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """One row per row of pages (page_id, url; other columns are not read): page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; of those that fit, the longest
    (host and path together, then the host) decides, else default. A null url, or one without ://, has an empty host
    and path, which no rule fits. Repeated rows are judged once and given back as often as they came; an empty table
    gives no rows.

    A url expands only to suffixes with as many labels, and path prefixes as long, as some rule has. Up to
    BROADCAST_RULES rules are broadcast; more are joined by the hash prefix of the distinct expressions."""
    spark = pages.sparkSession
    rules = list(rules)
    labels = sorted({h.count(".") + 1 for h, _, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    base = pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("times"))
    split = base.select("page_id", "url", "times", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = F.array_distinct(F.array(*[F.when(F.length("host") > 0, F.substring_index("host", ".", -k)) for k in labels])) if labels else F.array().cast("array<string>")
    paths = F.array_distinct(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: expression(h, p))))
    # The null at the end keeps a row for urls that expand to nothing.
    wide = split.withColumn("digest", F.explode(F.array_append(F.filter(pairs, lambda x: x.isNotNull()), F.lit(None).cast("string"))))
    table = rule_table(spark, rules)
    if len(rules) <= BROADCAST_RULES:
        met = wide.withColumn("short", F.substring("digest", 1, PREFIX)).join(F.broadcast(table), "short", "left")
        found = F.when(F.col("digest") == F.col("r_digest"), F.struct("r_len", "r_host_len", "r_rule", "r_verdict"))
    else:
        distinct = wide.where("digest is not null").select("digest").distinct().withColumn("short", F.substring("digest", 1, PREFIX))
        hit = distinct.join(table, "short").where("digest = r_digest")
        met = wide.join(hit.select("digest", "r_len", "r_host_len", "r_rule", "r_verdict"), "digest", "left")
        found = F.when(F.col("r_rule").isNotNull(), F.struct("r_len", "r_host_len", "r_rule", "r_verdict"))
    best = met.groupBy("page_id", "url", "times", "host", "path").agg(F.max(found).alias("best"))
    return best.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(
        "page_id", "host", "path", F.col("best.r_rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict")
    )
