"""URL filters, source mixing and quality rules against SQL and brute force."""

import collections
import math
import re

import duckdb
import pytest
import xxhash

from brookql.llm import mixing, quality_rules, url_filters

SF = "/root/testdata/sf0.001"


# --- URL filters ------------------------------------------------------------------------------------------------------
def plain_verdict(url, rules=url_filters.RULES):
    """(host, path, rule, verdict) by the contract, rule by rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for action, rule in rules:
        h, _, p = rule.partition("/")
        p = f"/{p}" if "/" in rule else ""
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(rule), len(h)) > best[0]):
            best = ((len(rule), len(h)), rule, action)
    return host, path, best and best[1], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com/en/", "http://COM/en/x", "https://a.b.Example.com/en/7/y?q#z", "http://example.com/en/6", "http://xexample.com/en/7",
    "http://com.evil/en/", "http://example.net/de/8", "http://example.net/de/9", "http://x.org/es", "http://x.org/es/#f", "http://x.org?u=/es/", "://net/de/", "http://..com/en/", "http://ÄÖ.com/en/ü",
    "http://" + "a." * 300 + "com/en/" + "y" * 5000,
]


def test_urls_against_the_contract(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS)] * 3
    urls = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_filters.judge_urls(urls, url_filters.rule_table(spark, url_filters.RULES)).collect()
    want = collections.Counter((i, *plain_verdict(u)) for i, u, _, _ in rows)
    assert collections.Counter(map(tuple, got)) == want
    assert not url_filters.judge_urls(urls.limit(0), url_filters.rule_table(spark, url_filters.RULES)).collect()


def test_many_rules_of_many_shapes(spark):
    rules = [("block" if i % 2 else "allow", f"h{i % 7}.example.com/" + "p" * (i % 90)) for i in range(600)] + [("block", "h1.example.com/ppp"), ("allow", "h1.example.com/ppp")]
    urls = [(i, f"http://s.h{i % 9}.example.com/" + "p" * (i % 100)) for i in range(300)]
    got = url_filters.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), url_filters.rule_table(spark, rules)).collect()
    blocking = {r for a, r in rules if a == "block"}
    rules = [("block" if r in blocking else "allow", r) for _, r in rules]  # given with both actions, a rule blocks
    assert sorted(map(tuple, got)) == sorted((i, *plain_verdict(u, rules)) for i, u in urls)


def test_prefixes_that_meet_are_confirmed(spark):
    """Rules whose digests share the short prefix don't fit each other's URLs."""
    rules = url_filters.rule_table(spark, url_filters.RULES).withColumn("rule_short", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("00000000"))
    urls = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert url_filters.judge_urls(urls, rules).first().rule is None


# --- mixing -----------------------------------------------------------------------------------------------------------
def test_mixing_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), ["a", "b", None, "Z", "big"][min(i % 11, 4)]) for i in range(2000)]
    rows += [(5, "same text", "a")] * 4 + [(None, "x y", "b"), (9, None, "a"), (10, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'z' as size", "1 as target")
    plan = mixing.plan_mix(docs, carry=["doc_id", "source"]).collect()
    assert len(plan) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, total, target = set(order), sum(sizes.values()), {}
    while True:  # water filling, step by step
        rest = total - sum(target.values())
        full = {s for s in left if sizes[s] * 3 * sum(weight[x] for x in left) <= rest * weight[s]}
        if not full:
            break
        target |= {s: 3 * sizes[s] for s in full}
        left -= full
    rest, w = total - sum(target.values()), sum(weight[x] for x in left)
    target |= {s: rest * weight[s] / w for s in left}
    taken = collections.Counter()
    for r in plan:
        s = r.row.source
        assert r.target == pytest.approx(target[s]) and r.source_size == sizes[s] and 0 <= r.copies <= 3
        taken[s] += r.copies * r["size"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 37
    again = mixing.plan_mix(docs.repartition(7, "text"), carry=["doc_id", "source"]).collect()
    key = lambda r: (str(r.row), r["size"], r.copies)
    assert sorted(map(key, plan)) == sorted(map(key, again))
    assert sum(r.copies for r in plan) == mixing.mix(docs.drop("size", "target")).count()
    assert not mixing.plan_mix(docs.limit(0)).collect()


def test_registered_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for query, sql in ((url_filters.op1_url_filters, url_filters.SQL), (mixing.op5_mixing, mixing.SQL)):
        df, want = query(spark, SF), con.sql(sql)
        cols = sorted(df.columns)
        assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(map(str, r)) for r in want.project(", ".join(cols)).fetchall())


# --- quality rules ----------------------------------------------------------------------------------------------------
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    t = text or ""
    words = WORDS.findall(t)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = collections.Counter(three)
    covered = {j for i, x in enumerate(three) if many[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def hash_of(x, seed=42):
    data = x.encode() if isinstance(x, str) else (x % (1 << 64)).to_bytes(8, "little")
    return xxhash.xxh64(data, seed=seed).intdigest()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_grams(text):
    import regex

    h = [hash_of(t) for t in regex.findall(r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", text or "")]
    pairs = [hash_of(b, seed=hash_of(a)) for a, b in zip(h, h[1:])]
    if h:
        pairs.append(hash_of(h[-1]))  # the last token and nothing
    return [signed(x) % quality_rules.BUCKETS for x in h + pairs]


TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "x " * 400, "l1 w\nl2\nl1 w\n \nl1 w", "α β γ α β γ δ", "#*$ %&|<> a#b", "a b c d a b c e a b c",
    " ".join(f"w{i % 50}q{i // 50}" for i in range(200)), "1 2 3 " * 30 + " ".join(f"u{i}" for i in range(90)), "a\x0bb\x0cc\rd\u00a0e \u2003f",
]


def test_quality_rules_against_brute_force(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(3, "one", 7), (None, "none has an id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(10, 1, 0), (11, 1, 0), (11, 0, 0), (0, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == len(rows)
    raw, good = collections.Counter(), collections.Counter()
    for i, t, _ in rows:
        g = plain_grams(t)
        raw.update(g)
        if i in (10, 11):
            good.update(g)
    r, n, b = sum(raw.values()), sum(good.values()), quality_rules.BUCKETS
    ratio = lambda k: math.log((good[k] + 1) / (n + b)) - math.log((raw[k] + 1) / (r + b))
    for row in got:
        counts = plain_counts(row.text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts, row.text
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        g = plain_grams(row.text)
        score = sum(map(ratio, g)) / len(g) if g else 0.0
        assert row.base_failed == failed and row.score == pytest.approx(score, abs=1e-5)
        assert row.kept == (not failed and row.score >= quality_rules.THRESHOLD)
    assert not quality_rules.judge(docs.limit(0), labels).collect()
    assert all(x.score == 0 for x in quality_rules.judge(docs, labels.limit(0)).collect())
