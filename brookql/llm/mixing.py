"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets are filled like vessels: each source gets its weight's share of all words, capped at ``cap`` times its own
size, what is over being shared again by weight.  Within a source every document expects target / source size copies.
These are summed in order of size, one random offset is added, and a document comes out once for each integer boundary
that its interval crosses.  Sums are integers (billionths of a copy), so reruns agree exactly.

The prefix sum has two levels: documents are put in (size class, id class) buckets of their source, a window sums
within a bucket, and a second one, over at most ``STRATA`` * ``SPREAD`` rows a source, sums the buckets before it.  So a
source with a third of all rows is spread over many tasks.  Running in order of size makes the words that are taken come near
the target, whatever the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, materialise, table

UNIT = 1_000_000_000
SPREAD = 256
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 20240607


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stratum(size: Column) -> Column:
    """A size class about an eighth of its size wide: bit length, then the three bits after the first."""
    bits = F.length(F.bin(size)).cast("long")
    return bits * 8 + F.expr("cast(shiftright(size, cast(greatest(length(bin(size)) - 4, 0) as int)) & 7 as long)")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(s_null, s, source_size, target) from rows (s_null, s, size): one row a source."""
    by = sizes.groupBy("s_null", "s").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy("s_null", "s")) - 1
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int")))
    order = W.orderBy(F.col("source_size") / F.col("w"), "s_null", "s")
    by = by.withColumns({
        "k": F.row_number().over(order),
        "total": F.sum("source_size").over(W.partitionBy()),
        "before": F.coalesce(F.sum(F.col("source_size") * cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    by = by.withColumn("full", F.col("source_size") * cap * F.col("rest") <= (F.col("total") - F.col("before")) * F.col("w"))
    level = F.when(~F.col("full"), (F.col("total") - F.col("before")) / F.col("rest"))
    by = by.withColumn("level", F.first(level, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), (F.col("source_size") * cap).cast("double")).otherwise(F.col("level") * F.col("w"))
    return by.select("s_null", "s", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, carry: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: the struct ``row`` of the columns in ``carry`` (all by default), ``size`` in words,
    ``source_size``, ``target`` of the source, and ``copies`` that the mix takes (0 to ``cap``).

    Null or blank texts have size 0; they expect copies like any other document of their source, and take no words.  A
    null source is a source of its own, last in order.  A source without words gets target 0 and no copies; an empty table
    gives an empty plan.  Equal rows are kept apart and may get different numbers of copies; rows that differ anywhere have a fixed order, so reruns agree.  Sources hold at most
    3e9 documents a bucket.
    """
    carry = docs.columns if carry is None else carry
    whole = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), n_words(F.col("text")).alias("size"),
        F.col("source").isNull().alias("s_null"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"),
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), F.xxhash64(*[F.col(f"`{c}`") for c in whole]).alias("row_tie"),
    )
    bucket = stratum(F.col("size")) * SPREAD + F.pmod(F.coalesce(F.col("id"), F.lit(0)).cast("long"), F.lit(SPREAD))
    keys = ["s_null", "s", "bucket"]
    narrow = docs.select(
        n_words(F.col("text")).alias("size"), F.col("source").isNull().alias("s_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"), F.col("doc_id").alias("id"),
    ).withColumn("bucket", bucket).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    narrow = materialise(narrow)  # a row for each bucket: words are counted once for it, once for the rows
    per_copy = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("s_null").cast("string"), F.lit("|"), F.col("s")).cast("binary")), 1, 8), 16, 10)
    before = F.sum(F.col("n") * F.col("e") % UNIT).over(W.partitionBy("s_null", "s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    buckets = (
        narrow.join(source_targets(narrow, weights, cap), ["s_null", "s"]).withColumn("e", per_copy)
        .withColumn("start", (F.coalesce(before, F.lit(0)) + offset.cast("long") % UNIT) % UNIT)
        .select(*keys, "source_size", "target", "e", "start")
    )
    order = W.partitionBy(*keys).orderBy("size", "id", "tie", "row_tie").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("bucket", bucket).join(buckets, keys).withColumn("upto", F.col("start") + F.sum("e").over(order))
    copies = F.expr(f"upto div {UNIT} - (upto - e) div {UNIT}")
    return d.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as :func:`plan_mix` takes it."""
    plan = plan_mix(docs, **how).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS s_null,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
b AS (SELECT *, (length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7)) * {SPREAD}
  + ((coalesce(doc_id, 0) % {SPREAD}) + {SPREAD}) % {SPREAD} AS bucket FROM d),
n AS (SELECT s_null, s, bucket, count(*) AS n, sum(size)::BIGINT AS size FROM b GROUP BY ALL),
t0 AS (SELECT s_null, s, sum(size)::BIGINT AS source_size FROM n GROUP BY ALL),
t1 AS (SELECT *, (row_number() OVER (ORDER BY s_null, s) - 1) % 3 + 1 AS w FROM t0),
t2 AS (SELECT *, row_number() OVER o AS k, sum(source_size) OVER () AS total,
  coalesce(sum(source_size * 3) OVER (ORDER BY source_size / w, s_null, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY source_size / w, s_null, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM t1 WINDOW o AS (ORDER BY source_size / w, s_null, s)),
t3 AS (SELECT *, CASE WHEN source_size * 3 * rest <= (total - before) * w THEN NULL ELSE (total - before)::DOUBLE / rest END AS lv FROM t2),
t4 AS (SELECT *, first_value(lv IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM t3),
t AS (SELECT s_null, s, source_size, CASE WHEN level IS NULL THEN (source_size * 3)::DOUBLE ELSE level * w END AS target FROM t4),
e AS (SELECT n.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT}) ELSE 0 END::BIGINT AS e
  FROM n JOIN t USING (s_null, s)),
p AS (SELECT *, (coalesce(sum(n * e % {UNIT}) OVER (PARTITION BY s_null, s ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + ('0x' || substr(md5('{SEED}|' || s_null::VARCHAR || '|' || s), 1, 8))::BIGINT % {UNIT}) % {UNIT} AS start FROM e),
q AS (SELECT doc_id, b.size, source_size, target, e, start
  + sum(e) OVER (PARTITION BY b.s_null, b.s, b.bucket ORDER BY b.size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM b JOIN p ON b.s_null = p.s_null AND b.s = p.s AND b.bucket = p.bucket)
SELECT doc_id, size, source_size, target, (size * (upto // {UNIT} - (upto - e) // {UNIT}))::BIGINT AS taken FROM q
"""
