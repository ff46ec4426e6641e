import random

import pytest
import sentencepiece

from brookql.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_ids_equal_the_library(library):
    rng = random.Random(3)
    letters = "abcdefgh ehtinos ABC  123.,;!\"\n\té漢字の😀$#²½_-/\x00ñß"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["a" * 500, "thethethe" * 300, " " * 300 + "x" * 200, "漢字" * 400, "²..", "x²..y", "", " ", "\n"]
    v = pieces.vocabulary(pieces.MODEL)
    for t, ids in zip(texts, v.encode(texts)):
        assert ids.tolist() == library.encode(t)
        assert v.decode(ids.tolist()) == t


def test_frames(spark):
    rows = [(1, "a b", 7), (2, None, 8), (3, "", 9), (3, "", 9), (None, "▁a▁ b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ids int")
    out = pieces.encode(docs)
    assert out.columns == ["doc_id", "ids", "n_ids", "round_trip"]
    assert all(r.round_trip and len(r.ids) == r.n_ids for r in out.collect())
    back = [(r.doc_id, r.text) for r in pieces.decode(out).collect()]
    assert sorted(back, key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert not pieces.encode(docs.limit(0)).collect()
