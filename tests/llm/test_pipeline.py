"""Each stage of the pipeline on small documents with null, empty, repeated and planted rows."""

import collections
import random

import pytest

import corpus_pipeline as cp
from brookql.llm import exact_spans, near_dups, pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows, passage = [], prose(rng, 70)
    for i in range(60):
        rows.append((i, prose(rng, rng.randint(20, 120)), rng.choice(["en", "de", None]), rng.choice(["web", "news", None])))
    for i in range(5):
        rows.append((100 + i, rows[i][1], "en", "web"))  # copies
        words = rows[10 + i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((110 + i, " ".join(words * 3), "en", "web"))
        rows.append((120 + i, f"{prose(rng, 40)} {passage} {prose(rng, 40)}", "en", "news"))
    rows += [(200, None, "en", "web"), (201, "", None, None), (None, prose(rng, 30), "en", "web"), (202, " \n ", "en", "web"), (0, rows[0][1], "de", "news"), (1, "another text of this id", "en", "web")]
    rows = [(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", kept string, size int")
    return rows, df


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng, folder = random.Random(9), str(tmp_path_factory.mktemp("tables"))
    rows = [(i, prose(rng, 30) + (" vexo" if i % 4 == 0 else ""), "en", "web", 1) for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_toxic_go_and_clean_stay(spark, sf):
    folder, rows = sf
    given = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", "en", "web", 0), (None, rows[1][1], "en", "web", 1), rows[1]], SCHEMA).withColumn("toxicity", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    out = cp.drop_toxic(spark, given, folder)
    assert out.columns == cp.COLUMNS
    left = collections.Counter(r.doc_id for r in out.collect())
    assert sum(1 for i in range(400) if i % 4 == 0 and i in left) <= 4 and sum(1 for i in range(400) if i % 4 and i not in left) <= 4
    assert left[900] == left[901] == left[None] == 1 and left[1] == 2


def test_one_of_each_group_stays(spark, docs):
    rows, df = docs
    out = cp.drop_near_duplicates(spark, df, "")
    assert out.columns == cp.COLUMNS
    left = [(r.doc_id, r.text) for r in out.collect()]
    sets = collections.defaultdict(list)
    for i, t, *_ in rows:
        sets[i].append(near_dups.real_shingles(t or "", 5))
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert sorted((i for i, _ in left if i is not None)) == [i for i in ids if root(i) == i]
    assert sum(i is None for i, _ in left) == 1


def test_repeated_spans_go(spark, docs):
    rows, df = docs
    out = cp.drop_repeated_spans(spark, df, "")
    assert out.columns == cp.COLUMNS and out.count() == len(rows)
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = collections.Counter()
    for (i, t, *_), b in zip(rows, raw):
        gone = set()
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        want[i, None if t is None else bytes(x for k, x in enumerate(b) if k not in gone).decode(errors="ignore")] += 1
    got = out.collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got)


def test_mix_keeps_rows_whole(spark, docs):
    rows, df = docs
    out = cp.mix_sources(spark, df, "")
    assert out.columns == cp.COLUMNS
    had = collections.Counter((r[0], r[1]) for r in rows)
    for x, n in collections.Counter((r.doc_id, r.text) for r in out.collect()).items():
        assert n <= 3 * had[x]


def test_pieces_decode_to_the_text(spark, docs):
    rows, df = docs
    out = cp.to_pieces(spark, df, "").collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    v = pieces.vocabulary(pieces.MODEL)
    assert collections.Counter(v.decode(r.ids) for r in out) == collections.Counter(t or "" for _, t, *_ in rows)


def test_run(spark, sf):
    folder, rows = sf
    out = cp.run(spark, folder)
    got = out.collect()
    assert {"doc_id", "ids", "n_ids"} <= set(out.columns) and all(r.round_trip for r in got)
    assert 250 <= len({r.doc_id for r in got}) <= 310
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_dedup", "span_dedup", "mixing", "pieces"]


def test_empty_tables(spark, sf):
    folder, _ = sf
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(spark, none, folder).collect() == [], name


def test_spans_against_brute_force_of_bytes(spark):
    """Copies, overlaps, repeats within a text, one byte too few, borders of characters."""
    rng = random.Random(4)
    a, b = prose(rng, 60).replace("a", "é"), prose(rng, 90)
    texts = [a, "x" + a, a[: len(a) // 2] + "|" + a[len(a) // 2 :], b, b[5:] + b[:30], b + b, "z" * 500, "y" * 200, "y" * 200, "w" * 200, "w" * 199, prose(rng, 50), None, "", b[:250] + "q", "q" + b[:250]]
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in enumerate(texts)] + [(3, b, 6, "d")], "doc_id long, text string, n_removed int, spans string")
    rows = [(i, (t or "").encode()) for i, t in enumerate(texts)] + [(3, b.encode())]
    seen = collections.Counter(x[i : i + 200] for _, x in rows for i in range(len(x) - 199))
    want = []
    for i, x in rows:
        gone = [False] * len(x)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        import hashlib

        want.append((i, len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()))
    got = exact_spans.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
