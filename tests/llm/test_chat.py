"""The template compiler, and conversations against SQL and a plain reading."""

import hashlib
import random

import duckdb
import pytest

from brookql.llm import chat_format as cf

SF = "/root/testdata/sf0.001"
TALK = [{"role": "system", "text": "be kind"}, {"role": "user", "text": " hi "}, {"role": "assistant", "text": "yo"}]


def say(template, **env):
    env.setdefault("messages", iter(TALK))
    return "".join(p for p, _ in cf.compile_template(template)(**env))


@pytest.mark.parametrize("template, want", [
    ("plain", "plain"),
    ("{{ 'a' + 'b' }}{{ 1 + 2 }}", "ab3"),
    ("{# no #}{{ 'x' | escape }}", "x"),
    ("{% if not a and (b or c) %}1{% elif b == 'q' %}2{% else %}3{% endif %}", "3"),
    ("{{ messages[0].text }}|{% for m in messages %}{{ m['role'] }},{% endfor %}", "be kind|system,user,assistant,"),
    ("{% for m in messages %}{% if loop.first %}<{% endif %}{{ loop.index }}{% if loop.last %}>{% endif %}{% endfor %}", "<123>"),
    ("{% for m in messages %}{{ loop.previtem.role }}-{{ loop.nextitem.role }};{% endfor %}", "-user;system-assistant;user-;"),
    ("{% if messages[0].role == 'system' %}{% set s = messages[0].text %}{% endif %}{% for m in messages %}{% if m.role == 'user' %}[{{ s }}] {{ m.text | trim }}{% endif %}{% endfor %}", "[be kind] hi"),
    ("{% for m in messages %}{% endfor %}{{ messages[2].text | upper }}", "YO"),
    ("{{ messages[9].text }}{{ nothing.at.all }}{{ 'abc' | length }}", "3"),
])
def test_templates(template, want):
    assert say(template) == want


@pytest.mark.parametrize("template", [
    "{{ a.__class__() }}", "{{ open('x') }}", "{{ 'a' | evil }}", "{% import os %}", "{% for m in messages %}", "{% if a %}", "{{ a + }}", "{{ a[0 }}", "{{ ) }}", "{% set loop = 1 %}", "{% endfor %}", "{{ a b }}", "{{ 1.5 }}",
])
def test_refusals(template):
    with pytest.raises(cf.TemplateError):
        cf.compile_template(template)


def test_python_attributes_are_out_of_reach():
    assert say("{{ messages.__class__ }}{{ messages.source }}{{ messages['keep'] }}{% for m in messages %}{{ m.keys }}{{ m['__class__'] }}{% endfor %}") == ""
    assert say("{% for c in word %}{{ c }}{% endfor %}", word="text") == ""


def test_folding():
    tree = cf.fold(cf.parse("a{{ 'b' + 'c' }}{% if 'x' == 'y' %}no{{ z }}{% else %}d{% endif %}"), cf.FILTERS)
    assert tree[0] == cf.Out(cf.Const("abc")) and tree[1] == cf.If(((cf.Const(True), (cf.Out(cf.Const("d")),)),))


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "/", "s>", ">", "[", "INST]", "/INST]", "\\", "<TURN>>", "<<TEXT>>", "</s>", "a", " "]) for _ in range(rng.randint(0, 9)))
        assert cf.unescape(cf.escape(t)) == t and not any(c in cf.escape(t) for c in cf.CONTROLS)


def test_conversations(spark):
    rng = random.Random(2)
    words = ["</s>", "[INST]", "ok", "<<TURN>>", "\\", "é", "\n", " ", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool<s>"]), rng.choice([None, "".join(rng.choice(words) for _ in range(6))])) for c in (1, 2, 3, None) for t in range(rng.randint(1, 9))]
    rows += [(5, 0, "assistant", "same")] * 3 + [(5, None, "user", "first"), (6, 0, "user", "long " * 100_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, last int, formatted string")
    got = {r.conv_id: r for r in cf.digests(cf.format_turns(df)).collect()}
    assert len(got) == 6
    for c, r in got.items():
        mine = sorted(((t is not None, t or 0, role or "", text or "") for cc, t, role, text in rows if cc == c))
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in mine).encode()).hexdigest()
        loss = "".join(text for *_, role, text in mine if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not cf.format_turns(df.limit(0)).collect()


def test_templates_that_see_neighbours(spark):
    template = "{% for m in messages %}{% if loop.first %}<begin>{% endif %}{% generation %}{{ m.text }}{% endgeneration %}{% if not loop.last %},{% endif %}{% endfor %}<end>"
    df = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", "yy"), (2, 0, "a", "z")], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r["last"], r.formatted, [tuple(m) for m in r["mask"]]) for r in cf.format_turns(df, template).collect())
    assert got == [(1, False, "<begin>x,", [(7, 1)]), (1, True, "yy<end>", [(0, 2)]), (2, True, "<begin>z<end>", [(7, 1)])]


def test_registered_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    df, want = cf.op4_chat_format(spark, SF), con.sql(cf.SQL)
    cols = sorted(df.columns)
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(map(str, r)) for r in want.project(", ".join(cols)).fetchall())
