"""Trusted documents are told from others exactly, and the texts of most others are never moved."""

import collections

from pyspark.sql import functions as F

from brookql.llm import quality_rules as qr

ROWS = [*((i, f"text {i}") for i in range(-500, 500)), (7, "again"), (7, "text 7"), (None, "no id"), (8, None)]


def test_marks_are_exact(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for bits, good in ((1 << 22, range(-500, 500, 3)), (64, range(-500, 500, 3)), (1 << 22, ()), (128, (7, 10**12))):
        monkeypatch.setattr(qr, "FILTER_BITS", bits)
        trusted = spark.createDataFrame([(i,) for i in good], "doc_id long")
        got = collections.Counter(map(tuple, qr.marked(docs, trusted).collect()))
        assert got == collections.Counter((i, t, int(i is not None and i in set(good))) for i, t in ROWS)


def test_few_others_pass(spark):
    maybe = qr.maybe_in(spark.createDataFrame([(i,) for i in range(0, 3000, 3)], "doc_id long"))
    passed = {r.id for r in spark.range(3000).where(maybe(F.col("id"))).collect()}
    assert passed >= set(range(0, 3000, 3)) and len(passed) < 1050


def test_one_plan_at_every_size(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    trusted = spark.createDataFrame([(7,)], "doc_id long")
    plan = qr.marked(docs, trusted)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
