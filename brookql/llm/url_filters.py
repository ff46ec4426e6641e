"""URL block and allow lists, in DataFrame functions only.

Every URL is expanded into the (host suffix, path prefix) expressions whose shapes (label count, path length) occur among the rules; the
expressions meet the rules in an equi-join on a 32-bit prefix of their SHA-256, then the full digests confirm a meeting,
and the longest rule that fits decides.  The shapes are one array in the plan, however many; a URL has expressions only of those
that its own labels and path can have.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: (action, rule): the rules of the query.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule's precedence is one long: (characters in all) * SPAN + (characters of the host) * 2 + (1 if it blocks).
SPAN = 1 << 24


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    return F.when(host == "", 0).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."))) + 1)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]] | DataFrame) -> DataFrame:
    """(digest, short, precedence, n_labels, path_chars) of the rules, one row for each distinct host and path.

    ``rules``: (action, rule) pairs or a DataFrame with those columns; a rule is a host with an optional path.
    If a rule is given with both actions, it blocks.
    """
    df = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "action string, rule string")
    host = F.translate(F.regexp_extract("rule", r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract("rule", r"^[^/?#]*(.*)$", 1)
    df = df.where(F.col("rule").isNotNull() & F.col("action").isin("block", "allow")).select("action", host.alias("h"), path.alias("p"))
    weight = (F.length("h") + F.length("p")).cast("long") * SPAN + F.length("h") * 2 + (F.col("action") == "block").cast("int")
    return (
        df.where("h != ''").groupBy("h", "p").agg(F.max(weight).alias("precedence"))
        .select(
            F.sha2(F.concat("h", "p"), 256).alias("rule_digest"), "precedence",
            labels_of(F.col("h")).alias("n_labels"), F.length("p").alias("path_chars"),
        )
        .withColumn("rule_short", F.substring("rule_digest", 1, 8))
    )


def judge_urls(urls: DataFrame, rules: DataFrame, keys: Iterable[str] = ("page_id",), url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of ``urls``: its keys, host, path, rule (null if none fits) and verdict.

    ``rules`` comes from :func:`rule_table`.  A null URL or one without ``://`` has an empty host and path, fits no rule
    and gets ``default``; repeated rows are judged, and returned, as often as they come.  Other columns are ignored, so
    their names may clash with those made here.  The rules are broadcast only while Spark's size threshold allows it;
    beyond, the join is by shuffle and adaptive execution splits a hot host's partition.
    """
    keys = list(keys)
    shapes = sorted((r[0], r[1]) for r in rules.select("n_labels", "path_chars").distinct().collect())  # labels and lengths, not rules
    held = [f"k{i}" for i in range(len(keys))]
    d = urls.select(*[F.col(k).alias(h) for k, h in zip(keys, held)], F.col(url).alias("u"))
    d = d.withColumns({"h": url_host(F.col("u")), "p": url_path(F.col("u")), "row": F.monotonically_increasing_id()}).withColumn("n", labels_of(F.col("h")))
    d = d.withColumn("shapes", F.from_json(F.lit(json.dumps([{"k": k, "c": c} for k, c in shapes])), "array<struct<k: int, c: int>>"))
    fits = "filter(shapes, s -> s.k <= n and s.c <= length(p))"
    d = d.select("row", *held, "h", "p", F.expr(f"explode_outer(transform({fits}, s -> concat(substring_index(h, '.', -s.k), substring(p, 1, s.c))))").alias("e"))
    d = d.withColumn("digest", F.sha2("e", 256)).withColumn("short", F.substring("digest", 1, 8))
    met = d.join(rules, F.col("short") == F.col("rule_short"), "left")  # a meeting on the prefix
    met = met.withColumn("confirmed", F.when(F.col("digest") == F.col("rule_digest"), F.col("precedence")))
    best = met.groupBy("row", *held, "h", "p").agg(F.max("confirmed").alias("best"))
    host_chars = F.floor(F.col("best") % SPAN / 2).cast("int")
    path_chars = F.floor(F.col("best") / SPAN).cast("int") - host_chars
    rule = F.when(F.col("best").isNotNull(), F.concat(F.right(F.col("h"), host_chars), F.left(F.col("p"), path_chars)))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best") % 2 == 1, "block").otherwise("allow")
    return best.select(*[F.col(h).alias(k) for k, h in zip(keys, held)], F.col("h").alias("host"), F.col("p").alias("path"), rule.alias("rule"), verdict.alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


SQL = """
WITH rules(host, path, verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS rn,
  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT u.rn, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY u.rn ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON m.rn = u.rn AND m.k = 1
"""
