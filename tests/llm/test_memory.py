"""The driver gives back what it has freed, and holds the sample of the toxicity model in its small form."""

import gc

import numpy as np

from brookql.llm import shared, toxicity


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_freed_memory_goes_back(spark):
    many = [bytearray(50_000) for _ in range(4_000)]
    for x in many:
        x[::4096] = b"1" * len(x[::4096])
    many = many[-1:]  # what lies above the freed ones holds them in the process
    gc.collect()
    held = resident()
    assert shared.trim_driver(spark)  # the JVM too
    assert resident() < held - 100 and many


def test_each_table_written_gives_memory_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "trim_driver", calls.append)
    shared.discard(shared.materialise(spark.range(3)))
    assert len(calls) == 1


def test_the_sample_stays_small(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "Model", lambda docs, y: seen.extend(docs))
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    assert seen and all(x.dtype == np.uint16 for x in seen)
