"""Span removal with shards of a few hundred bytes, and the arrays themselves."""

import collections
import random

import numpy as np
import pytest

from brookql.llm import exact_spans as es
from brookql.llm import suffix_array as sa


def brute(texts, size):
    seen = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        out.append(sum(gone))
    return out


def made(rng, n):
    return "".join(rng.choice("ab cdé") for _ in range(n))


@pytest.mark.parametrize("shard", [1 << 20, 600])
def test_removed_bytes(spark, monkeypatch, shard):
    monkeypatch.setattr(es, "SHARD", shard)
    rng = random.Random(shard)
    passage, texts = made(rng, 260), []
    for _ in range(60):
        texts.append(made(rng, rng.randint(0, 500)) + passage[rng.randint(0, 40) : rng.randint(200, 260)] + made(rng, rng.randint(0, 300)))
    texts += texts[:7] + [passage, passage + passage, "x" * 700, "", made(rng, 199)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, d1 int")
    got = {r.doc_id: r.n_removed for r in es.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts], 200)


def test_a_text_longer_than_a_block(spark):
    rng = random.Random(5)
    long, passage = made(rng, 1_300_000), made(rng, 400)
    texts = [long[:900_000] + passage + long[900_000:], "q" + passage + "r", long[-700:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in es.remove_repeats(docs).collect()}
    n, m = len(passage.encode()), len(long[-700:].encode())
    assert n <= got[1][0] <= n + 2 and got[2] == (m, 1) and got[0][1] == 2 and got[0][0] == got[1][0] + m


def test_windows_of_shards_and_of_sides():
    rng = random.Random(1)
    for _ in range(40):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(8, 60))).encode() for _ in range(9)]
        for shard in (40, 1000):
            found = es.repeated_windows(texts, 8, shard)
            seen = collections.Counter(t[i : i + 8] for t in texts for i in range(len(t) - 7))
            assert all(f.tolist() == [seen[t[i : i + 8]] > 1 for i in range(len(t) - 7)] for t, f in zip(texts, found))
            sides = es.repeated_windows(texts, 8, shard, split=4)
            have = [{t[i : i + 8] for t in some for i in range(len(t) - 7)} for some in (texts[4:], texts[:4])]
            assert all(f.tolist() == [t[i : i + 8] in have[k >= 4] for i in range(len(t) - 7)] for k, (t, f) in enumerate(zip(texts, sides)))


def test_arrays_of_random_bytes():
    rng = np.random.default_rng(3)
    for n, letters in ((1, 2), (50, 1), (300, 2), (500, 4)):
        data = rng.integers(0, letters, n).astype(np.uint8)
        raw = data.tobytes()
        order = sa.suffix_array(data)
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(n))
        low, high = sa.find(data, order, data, np.arange(max(0, n - 5)), 5)
        for p, (a, b) in enumerate(zip(low, high)):
            assert sorted(order[a:b]) == [i for i in range(n) if raw[i : i + 5] == raw[p : p + 5]]
