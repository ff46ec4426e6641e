"""The two classifiers: held-out accuracy, independence of what may not be used, and odd inputs."""

import random
import zlib

import numpy as np
import pytest

from brookql.llm import quality_model, toxicity

SF = "/root/testdata/sf0.01"


def auc(scores, truth):
    s, y = np.asarray(scores), np.asarray(truth)
    above = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
    return above


def held_out(query, spark, label, mod, rest):
    got = query(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    some = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    return auc([x[0] for x in some], [x[1] for x in some]), np.mean([x[1] == x[2] for x in some]), np.mean([x[1] == 0 for x in some])


def test_quality_held_out(spark):
    area, right, _ = held_out(quality_model.op2_quality_model, spark, "quality", 3, 1)
    assert area > 0.95 and right > 0.85


def test_toxicity_held_out(spark):
    area, right, plain = held_out(toxicity.op6_toxicity, spark, "toxic", 5, 0)
    assert area > 0.85 and right >= plain


def corpus(n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["sol", "mar", "luz", "pan", "rio"] if i % 2 else ["sun", "sea", "light", "bread", "river"]) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["zorg", "vexo"])
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(bad)))
    return rows, labels


def test_toxicity_learns_words_and_bears_odd_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, *rows[:50], (1000, None), (1001, ""), (1002, " ?! "), (None, "zorg"), (1003, "sun " * 50_000 + "zorg")], "doc_id long, text string").selectExpr("*", "'x' as toxicity", "1 as y")
    table = spark.createDataFrame([*labels, (None, 0, 1), (5, 0, 0), (1000, 0, None), (1001, 0, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.toxicity for r in got}
    wrong = [i for i, _, t in labels if (by[i] >= 0.5) != bool(t)]
    assert len(wrong) <= 6 and by[1003] >= 0.5 and by[1000] < 0.5 and by[1001] == by[1000]
    assert not toxicity.score(docs.limit(0), model).collect()


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_nothing_to_learn_from(spark, module):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    if module is toxicity:
        scores = [r.toxicity for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()]
    else:
        scores = [r.score for r in quality_model.score(docs, *quality_model.fit(docs, labels)).collect()]
    assert len(scores) == 2 and all(0 <= s <= 1 for s in scores)


def test_repeated_ids_are_one_row_of_the_sample(spark):
    docs = spark.range(20_000).selectExpr("id % 2 as doc_id", "if(id % 2 = 0, 'good text here', 'bad text there') as text")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    from brookql.llm.shared import label_sample, labelled_texts

    assert labelled_texts(docs, label_sample(labels, "quality", 10, 3, 5)).count() == 2


def test_word_vectors_against_brute_force(spark):
    texts = ["a b c a", "b a", None, "", "C c 12"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    place, sign = quality_model.index_vectors()
    import pyarrow as pa

    want = np.zeros((quality_model.VOCAB, quality_model.DIM), np.int64)
    for _, _, ids, rows in quality_model._blocks(pa.chunked_array([pa.array(texts, pa.string())])):
        for i, j in zip(rows[:-1], rows[1:]):
            for x in range(i, j):
                for y in range(max(i, x - quality_model.WINDOW), min(j, x + quality_model.WINDOW + 1)):
                    if x != y:
                        for k in range(quality_model.NONZERO):
                            want[ids[x], place[ids[y], k]] += int(sign[ids[y], k])
    assert (quality_model.word_sums(docs) == want).all()
