import hashlib

import numpy as np

from brookql.llm import chat_format, exact_spans, near_dups, suffix_array, url_filters


def test_escape_is_reversible():
    for t in ("</s>[INST] ok [/INST]", "<\\/s>", "<<s>", "plain"):
        assert chat_format.unescape(chat_format.escape(t)) == t
        assert not any(c in chat_format.escape(t) for c in chat_format.CONTROLS)


def test_suffix_array_and_prefixes():
    data = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    raw = data.tobytes()
    sa = suffix_array.suffix_array(data)
    assert [raw[i:] for i in sa] == sorted(raw[i:] for i in range(len(raw)))
    lcp = suffix_array.common_prefixes(data, sa)
    for k in range(1, len(sa)):
        a, b = raw[sa[k - 1]:], raw[sa[k]:]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


def test_spans_and_groups(spark):
    x, y = "abc " * 3 + "".join(chr(97 + i * 7 % 26) for i in range(300)), "other words here " * 5
    rows = [(1, x), (2, "pre " + x), (3, y), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in exact_spans.remove_repeats(docs).collect()}
    assert out[1].n_removed > 200 and out[3].n_removed == 0
    assert out[4].kept_sha256 == hashlib.sha256(b"").hexdigest()
    links = {r.doc_id: r for r in near_dups.link(spark.createDataFrame([(1, "a b c d"), (2, "A b c d"), (3, None), (4, "z")], docs.schema), width=2).collect()}
    assert links[2].component_id == 1 and not links[2].kept and links[3].n_shingles == 0 and links[4].kept


def test_urls(spark):
    urls = spark.createDataFrame([(1, "http://A.Example.com/en/7x?q"), (2, "http://b.com/en/"), (3, None), (3, None)], "page_id long, url string")
    out = sorted((r.page_id, r.verdict, r.rule) for r in url_filters.judge_urls(urls, url_filters.rule_table(spark, url_filters.RULES)).collect() if r.rule)
    assert out == [(1, "allow", "example.com/en/7"), (2, "block", "com/en/")]
