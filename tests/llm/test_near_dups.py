"""Near duplicates against brute force."""

import random
import time

import pytest

from brookql.llm import near_dups


def brute(rows, width, percent):
    """{doc_id: component} by comparing all pairs of real sets."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(near_dups.real_shingles(t or "", width))
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(parent)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def held(spark, rows, width=2):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, component int")
    return near_dups.link(docs, width=width).collect()


def noisy(rng, words, share):
    out = [w if rng.random() > share else rng.choice("pqrstuvw") * 3 for w in words]
    return " ".join(out)


def test_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 40, 150]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((i, noisy(rng, base, rng.choice([0, 0.01, 0.05, 0.1]))))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t"), (i + 3, "W1"), (i + 4, "w1 "), (None, "w1"), (i + 5, "a b"), (i + 6, "b a"), (i + 7, "A\nb")]
    rows += rows[:15]  # repeated rows
    want = brute(rows, 2, 80)
    got = held(spark, rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    for r in got:
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = {i: len(near_dups.real_shingles(t or "", 2)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)


def test_threshold_is_exact(spark):
    a = " ".join(f"t{k}" for k in range(10))  # 9 shingles of two
    b = " ".join([f"t{k}" for k in range(10)] + ["x", "y"])  # 11, all 9 common: 9/11 >= 0.8
    c = " ".join([f"t{k}" for k in range(10)] + ["x", "y", "z"])  # 12: 9/12 is too little, 11/12 with b isn't
    d = " ".join([f"t{k}" for k in range(8)] + ["q", "r", "s"])
    got = {r.doc_id: r.component_id for r in held(spark, [(1, a), (2, b), (3, c), (4, d)])}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    got = {r.doc_id: r.component_id for r in held(spark, [(1, a), (3, c)])}
    assert got == {1: 1, 3: 3}


def test_words_of_much_symmetry_differ(spark):
    turn = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(10):
        word += word.translate(turn)
    got = {r.doc_id: r.component_id for r in held(spark, [(1, word), (2, word.translate(turn))])}
    assert got == {1: 1, 2: 2}


def test_ids_with_several_texts_join_them(spark):
    got = held(spark, [(1, "a b c d"), (2, "k l m n"), (2, "a b c d"), (3, "k l m n"), (4, "z")])
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_many_copies_are_linear(spark):
    words = [f"v{k}" for k in range(60)]
    x, y = " ".join(words), " ".join(words[:-2] + ["p", "q"])
    began = time.time()
    base = spark.range(60_000).selectExpr("id % 2 as doc_id", f"if(id % 2 = 0, '{x}', '{y}') as text")
    got = near_dups.link(base, width=2).groupBy("doc_id", "component_id").count().collect()
    assert sorted(got) == [(0, 0, 30_000), (1, 0, 30_000)] and time.time() - began < 120


@pytest.mark.parametrize("block", [8])
def test_many_blocks_find_all(spark, monkeypatch, block):
    """Keys with many members are dealt into blocks; links between blocks are found all the same."""
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rng = random.Random(2)
    rows = []
    for g in range(6):
        base = [f"g{g}x{k}" for k in range(60)]
        rows += [(100 * g + k, noisy(rng, base, 0.03)) for k in range(30)]
    assert {r.doc_id: r.component_id for r in held(spark, rows)} == brute(rows, 2, 80)


def test_empty_table(spark):
    assert near_dups.link(spark.createDataFrame([], "doc_id long, text string")).collect() == []
