"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and punctuation runs, alone and in pairs, are hashed into ``BUCKETS`` buckets.  Two smoothed multinomials are
counted: one over every document (the raw corpus) and one over trusted documents (those labelled good).  A document's score is
the mean over its n-grams of log p(trusted) - log p(raw); it is kept if the score is at least ``THRESHOLD``.  The
table of log ratios has a fixed size (``BUCKETS`` doubles), so it travels as a literal.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, table

BUCKETS = 1 << 14
#: Bits of the filter before the join with trusted ids.
FILTER_BITS = 1 << 22
SMOOTHING = 1.0
THRESHOLD = -0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\s]+"


def _long(x: Column) -> Column:
    return x.cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed put in place of columns so named.

    All counts of a null or blank text are 0, and it fails.  Every count looks at the whole text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_words", F.filter(F.split(t, SPACE), lambda x: x != ""))
    n = F.size("_words")
    d = d.withColumn("_h", F.transform("_words", lambda x: F.xxhash64(x)))
    triple = F.transform(F.slice("_h", 1, n - 2), lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)))
    d = d.withColumn("_three", F.when(n >= 4, triple))
    again = F.size(F.array_distinct("_three")) < F.size("_three")
    sort = F.sort_array(F.transform("_three", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))  # array_sort would call a lambda to compare
    d = d.withColumn("_sorted", F.when(F.col("_three").isNotNull() & again, sort))
    at = lambda i: F.get("_sorted", i)["x"]
    twin = F.filter(
        F.transform("_sorted", lambda s, k: F.when(s["x"].eqNullSafe(at(k - 1)) | s["x"].eqNullSafe(at(k + 1)), s["i"])),
        lambda i: i.isNotNull(),
    )
    d = d.withColumn("_at", F.sort_array(twin))
    step = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_lines", lines)
    counts = {
        "n_words": _long(n),
        "word_chars": _long(F.length(F.regexp_replace(t, SPACE, ""))),
        "n_symbols": _long(F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))),
        "n_dup_lines": _long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_repeat_words": _long(F.when(F.col("_at").isNull(), 0).otherwise(F.aggregate(step, F.lit(0), lambda a, x: a + x))),
    }
    d = d.withColumns(counts).drop("_words", "_h", "_three", "_sorted", "_at", "_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return d.withColumn("base_failed", failed)


def grams(text: str = "text") -> Column:
    """Buckets (from 1) of the tokens and of the pairs of neighbouring tokens."""
    hashes = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), 0), lambda x: F.xxhash64(x))
    pairs = lambda h: F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    # the pair of the last token and nothing stands for the end of the text
    both = F.transform(F.array(hashes), lambda h: F.concat(h, pairs(h)))
    return F.transform(F.element_at(both, 1), lambda x: (F.pmod(x, F.lit(BUCKETS)) + 1).cast("int"))


def maybe_in(ids: DataFrame) -> Callable[[Column], Column]:
    """Whether an id may be among the doc_ids of ``ids``: true for all that are, and for few others while those are fewer than FILTER_BITS.

    One bit a hash, 64 to a word; the words have a fixed number at most, whatever the number of ids, and travel as a literal.
    """
    bit = lambda x: F.pmod(F.xxhash64(x.cast("string")), F.lit(FILTER_BITS))
    at = ids.where("doc_id is not null").select(bit(F.col("doc_id")).alias("p"))
    words = at.groupBy(F.expr("int(p div 64)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("bits"))
    held = [0] * (FILTER_BITS // 64)
    for w, bits in words.collect():  # at most FILTER_BITS / 64 rows
        held[w] = bits
    table_ = F.from_json(F.lit(json.dumps(held, separators=(",", ":"))), "array<bigint>")
    return lambda x: F.coalesce(F.getbit(F.get(table_, F.floor(bit(x) / 64).cast("int")), (bit(x) % 64).cast("int")) == 1, F.lit(False))


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``docs`` with ``_good``: 1 where the doc_id is in ``trusted`` (distinct), else 0.

    Only rows that :func:`maybe_in` lets through are joined, so the texts of most others are never moved; the join then decides.
    The plan is the same at every size.
    """
    kind = docs.select("doc_id").union(trusted.select("doc_id")).schema["doc_id"].dataType  # as the join would compare them
    maybe = maybe_in(trusted.select(F.col("doc_id").cast(kind).alias("doc_id")))(F.col("doc_id").cast(kind))
    ids = trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_one"))
    some = docs.where(maybe).join(ids.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    return some.select(*docs.columns, F.coalesce("_one", F.lit(0)).alias("_good")).union(docs.where(~maybe).select("*", F.lit(0).alias("_good")))


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text") -> list[float]:
    """The log ratio of each bucket: counts of all of ``docs``, and of those whose doc_id is in ``trusted``."""
    d = marked(docs, trusted)
    counts = d.select(F.explode(grams(text)).alias("b"), F.col("_good").alias("g")).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"))
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for b, n, g in counts.collect():  # at most BUCKETS rows
        raw[b - 1], good[b - 1] = n, g
    r, t, a = sum(raw), sum(good), SMOOTHING
    if not t:
        return [0.0] * BUCKETS
    return [math.log((g + a) / (t + a * BUCKETS)) - math.log((n + a) / (r + a * BUCKETS)) for n, g in zip(raw, good)]


def with_score(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the mean log ratio of the text's n-grams, 0 for a text without any."""
    table_ = F.from_json(F.lit(json.dumps([round(x, 6) for x in ratios])), "array<double>")
    d = docs.withColumn("_grams", grams(text))
    total = F.aggregate("_grams", F.lit(0.0), lambda a, g: a + F.element_at(table_, g))
    return d.withColumn("score", F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(0.0)).drop("_grams")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with the base counts, base_failed, score and kept (columns so named are replaced).

    Without any trusted document all scores are 0, and the base counts alone decide.  Repeated rows are judged each; the
    statistics count them as often as they come.  Every document labelled good is trusted, even where another label of its id contradicts.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    ratios = log_ratios(docs.select("doc_id", "text"), good)
    d = with_score(base_counts(docs), ratios)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
