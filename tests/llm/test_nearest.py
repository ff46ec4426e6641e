"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from brookql.llm import nearest


def brute(rows, asked, k=5):
    """{(query, rank): (vec_id, score)} from usable rows of one size."""
    import collections

    fine = [(i, [float(x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dim = min(collections.Counter(len(v) for _, v in fine).items(), key=lambda x: (-x[1], x[0]))[0]
    ids = np.array([i for i, v in fine if len(v) == dim])
    x = nearest.scaled(np.array([v for _, v in fine if len(v) == dim]))
    out = {}
    for i, q in zip(ids, x):
        if asked(i):
            score = nearest.cosines(x, np.repeat(q[None], len(x), 0))
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            for r, j in enumerate(order, 1):
                out[int(i), r] = (int(ids[j]), score[j])
    return out


def run(spark, rows, asked="id % 10 = 0", kind="double", **how):
    v = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumnRenamed("vec_id", "id")
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest.search(v, v.where(asked), vec_id="id", **how).collect()}


def test_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(900)]
    rows += [(900 + i, rows[i][1]) for i in range(50)]  # equal vectors: ties
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] + [1.0] * 23), (2004, [1.0, 2.0]), (2005, [None] + [1.0] * 23)]
    want = brute(rows, lambda i: i % 10 == 0)
    got = run(spark, rows)
    assert got.keys() == want.keys()
    assert sum(got[x][0] == want[x][0] for x in want) >= 0.9 * len(want)
    for x, (i, score) in got.items():
        if i == want[x][0]:
            assert score == pytest.approx(want[x][1], abs=1e-12)


def test_extreme_sizes(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200])]
    got = run(spark, rows, asked="id = 0")
    assert {got[0, 1][0], got[0, 2][0]} == {2, 3} and got[0, 3][0] == 1
    assert [got[0, r][1] for r in (1, 2, 3)] == pytest.approx([1, 1, 2**-0.5])


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    assert run(spark, [(0, None)]) == {}
    assert run(spark, [(0, [1.0, 0.0]), (7, [0.0, 1.0])]) == {(0, 1): (7, 0.0)}


def test_repeated_rows_and_ids(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(5, [1.0, 0.1])] * 2 + [(10, [0.5, 0.5])]
    got = run(spark, rows)
    assert [got[0, r][0] for r in (1, 2)] == [5, 10] and [got[10, r][0] for r in (1, 2)] == [5, 0] and len(got) == 4


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_with_many_more_lists_than_probes(spark, clustered):
    """Recall over all rows, at probes that the sample chose."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 32))
    if clustered:
        x = rng.normal(size=(400, 32))[rng.integers(0, 400, 12_000)] + 0.3 * x
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    want = brute(rows, lambda i: i % 100 == 0)
    got = run(spark, rows, asked="id % 100 = 0", per_list=60)
    true = {(q, v) for (q, _), (v, _) in want.items()}
    assert len(true & {(q, v) for (q, _), (v, _) in got.items()}) >= 0.9 * len(true)


def test_structure_needs_few_probes():
    rng = np.random.default_rng(4)
    x = nearest.unit(rng.normal(size=(300, 32))[rng.integers(0, 300, 8000)] + 0.2 * rng.normal(size=(8000, 32))).astype(np.float32)
    assert nearest.fitted(x, 200, 5)[1] < 40
