"""Chat formatting: a small sandboxed template language, compiled to Python closures.

Text is parsed into a syntax tree, constants are folded, and each node becomes a closure.  The language has
``{{ expr }}``, ``{% for x in y %}``, ``{% if %}``/``{% elif %}``/``{% else %}``, ``{% set x = expr %}``, ``{% generation %}`` (marks what a
model is trained to say) and ``{# comments #}``.  Expressions have names, attributes and items of mappings, items of messages by number, string and integer
literals, ``+``, ``==``, ``!=``, ``not``, ``and``, ``or``, parentheses and the filters given at compile time.  Within a loop, ``loop`` has
index, index0, first, last, previtem and nextitem.  There is no way to reach a Python attribute, call or import.

A template renders a whole conversation.  Rendering is a generator over an iterator of messages that looks one message ahead, so a
conversation of any length needs the memory of three messages, and of those before the largest number that the template asks for.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Control strings of the format, and the template of the query.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<TURN>>", "<</TURN>>", "<<TEXT>>")
TEMPLATE = (
    "{# one turn after the other; roles other than user and assistant name themselves #}"
    "{% for m in messages %}"
    "{% if m.role == 'user' %}{{ '<s>' + '[INST] ' }}{{ m.text | escape }}{{ ' [/INST]' }}"
    "{% elif m.role == 'assistant' %}{{ ' ' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ ' </s>' }}"
    "{% else %}<<TURN>> {{ m.role | escape }} <<TEXT>> {{ m.text | escape }} <</TURN>>{% endif %}"
    "{% endfor %}"
)


class TemplateError(ValueError):
    """The template can't be parsed, or uses what the sandbox doesn't have."""


# --- control strings ----------------------------------------------------------------------------------------------
def _marked(extra: str) -> re.Pattern[str]:
    return re.compile("|".join(f"{re.escape(c[0])}(\\\\{extra}){re.escape(c[1:])}" for c in CONTROLS))


_RAW, _ESCAPED = _marked("*"), _marked("+")


def escape(text: str) -> str:
    """Put a backslash behind the first character of each control string (one more, if some are there already)."""
    return _RAW.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _ESCAPED.sub(lambda m: f"{m[0][0]}{m[0][2:]}", text)


# --- syntax tree --------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Attr:
    of: Any
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    at: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Out:
    expr: Any


@dataclass(frozen=True)
class For:
    var: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Set:
    name: str
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|.()\[\]]))")
_WORDS = {"and", "or", "not"}


class _Expr:
    def __init__(self, text: str) -> None:
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:]!r}")
            kind = next(i for i in range(1, 5) if m[i] is not None)
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self, *what: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != 1 and self.tokens[self.at][1] in what

    def take(self, kind: int | None = None) -> str:
        if self.at >= len(self.tokens) or kind is not None and self.tokens[self.at][0] != kind:
            raise TemplateError("expression breaks off")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Any:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def chain(self, below: Callable[[], Any], *ops: str) -> Any:
        node = below()
        while self.peek(*ops):
            op = self.take()
            node = Op(op, (node, below()))
        return node

    def either(self) -> Any:
        return self.chain(self.both, "or")

    def both(self) -> Any:
        return self.chain(self.negated, "and")

    def negated(self) -> Any:
        if self.peek("not"):
            self.take()
            return Op("not", (self.negated(),))
        return self.chain(self.sum, "==", "!=")

    def sum(self) -> Any:
        return self.chain(self.filtered, "+")

    def filtered(self) -> Any:
        node = self.atom()
        while self.peek("|"):
            self.take()
            node = Filter(node, self.take(3))
        return node

    def atom(self) -> Any:
        if self.peek("("):
            self.take()
            node = self.either()
            if not self.peek(")"):
                raise TemplateError("a parenthesis isn't closed")
            self.take()
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("expression breaks off")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == 2:
            return Const(int(text))
        if kind != 3 or text in _WORDS:
            raise TemplateError(f"unexpected {text!r}")
        node: Any = Name(text)
        while self.peek(".", "["):
            if self.take() == ".":
                node = Attr(node, self.take(3))
                continue
            node = Item(node, self.either())
            if not self.peek("]"):
                raise TemplateError("a bracket isn't closed")
            self.take()
        return node


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _PIECE.finditer(template):
        if m.start() > at:
            pieces.append(("text", template[at : m.start()]))
        if m[1] is not None:
            pieces.append(("out", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        pieces.append(("text", template[at:]))
    place = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        body: list[Any] = []
        while place < len(pieces):
            kind, text = pieces[place]
            place += 1
            if kind == "text":
                body.append(Out(Const(text)))
            elif kind == "out":
                body.append(Out(_Expr(text).whole()))
            else:
                word = text.split(None, 1)[0] if text else ""
                if word in ends:
                    return tuple(body), text
                if word == "for":
                    m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", text, re.S)
                    if not m:
                        raise TemplateError(f"can't read {text!r}")
                    inner, _ = block("endfor")
                    body.append(For(m[1], _Expr(m[2]).whole(), inner))
                elif word == "if":
                    branches, head = [], text
                    while True:
                        inner, end = block("elif", "else", "endif")
                        test = Const(True) if head == "else" else _Expr(head.split(None, 1)[1]).whole()
                        branches.append((test, inner))
                        if end == "endif":
                            break
                        head = end
                    body.append(If(tuple(branches)))
                elif word == "set":
                    m = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=\s*(.+)", text, re.S)
                    if not m or m[1] == "loop":
                        raise TemplateError(f"can't read {text!r}")
                    body.append(Set(m[1], _Expr(m[2]).whole()))
                elif word == "generation":
                    inner, _ = block("endgeneration")
                    body.append(Generation(inner))
                else:
                    raise TemplateError(f"no such tag: {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), ""

    return block()[0]


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "not": lambda a: not a,
}


def fold(node: Any, filters: dict[str, Callable[[str], str]]) -> Any:
    """The tree with constant expressions computed, dead branches gone and neighbouring constant text joined."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in (fold(n, filters) for n in node):
            if isinstance(x, Out) and isinstance(x.expr, Const):
                if out and isinstance(out[-1], Out) and isinstance(out[-1].expr, Const):
                    out[-1] = Out(Const(out[-1].expr.value + _text(x.expr.value)))
                    continue
                x = Out(Const(_text(x.expr.value)))
            out.append(x)
        return tuple(x for x in out if not (isinstance(x, Out) and x.expr == Const("")))
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        return Const(_OPS[node.op](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Op(node.op, args)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"no such filter: {node.name}")
        of = fold(node.of, filters)
        return Const(filters[node.name](_text(of.value))) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Attr):
        return Attr(fold(node.of, filters), node.name)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.at, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.expr, filters))
    if isinstance(node, Out):
        return Out(fold(node.expr, filters))
    if isinstance(node, For):
        return For(node.var, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        kept = []
        for test, body in node.branches:
            test = fold(test, filters)
            if isinstance(test, Const) and not test.value:
                continue
            kept.append((test, fold(body, filters)))
            if isinstance(test, Const):
                break
        return If(tuple(kept))
    return node


Env = dict[str, Any]


class Messages:
    """Messages read once, in order; items by number are looked ahead and kept for the loop (the first ``keep`` for good)."""

    def __init__(self, source: Iterable[dict], keep: int = 0) -> None:
        self.source, self.ahead, self.first, self.keep = iter(source), deque(), [], keep

    def __getitem__(self, i: int) -> dict | None:
        while len(self.first) <= i < self.keep and (m := next(self.source, None)) is not None:
            self.first.append(m)
            self.ahead.append(m)
        return self.first[i] if 0 <= i < len(self.first) else None

    def __iter__(self) -> Iterator[dict]:
        while True:
            if self.ahead:
                yield self.ahead.popleft()
                continue
            m = next(self.source, None)
            if m is None:
                return
            if len(self.first) < self.keep:
                self.first.append(m)
            yield m


def largest_number(node: Any) -> int:
    """The largest constant number that the template takes an item by, or -1."""
    if isinstance(node, Item):
        own = node.at.value if isinstance(node.at, Const) and isinstance(node.at.value, int) else -1
        return max(own, largest_number(node.of), largest_number(node.at))
    if isinstance(node, tuple):
        return max(map(largest_number, node), default=-1)
    return max((largest_number(v) for v in vars(node).values()), default=-1) if hasattr(node, "__dataclass_fields__") else -1


def _value(node: Any, filters: dict[str, Callable[[str], str]]) -> Callable[[Env], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Attr):
        of, name = _value(node.of, filters), node.name

        def attr(env: Env) -> Any:
            x = of(env)
            return x.get(name) if isinstance(x, dict) else None

        return attr
    if isinstance(node, Item):
        holder, place = _value(node.of, filters), _value(node.at, filters)

        def item(env: Env) -> Any:
            x, at = holder(env), place(env)
            if isinstance(x, dict):
                return x.get(at) if isinstance(at, str) else None
            return x[at] if isinstance(x, Messages) and isinstance(at, int) else None

        return item
    if isinstance(node, Filter):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda env: f(_text(of(env)))
    args = [_value(a, filters) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    op = _OPS[node.op]
    return lambda env: op(*(a(env) for a in args))


#: What a loop over messages yields behind each of them.
TURN = ("", None)
#: A closure yields (piece of text, whether it is under the loss mask).
Render = Callable[[Env, bool], Iterator[tuple[str, bool]]]


def _render(node: Any, filters: dict[str, Callable[[str], str]]) -> Render:
    if isinstance(node, tuple):
        parts = [_render(n, filters) for n in node]

        def block(env: Env, on: bool) -> Iterator[tuple[str, bool]]:
            for p in parts:
                yield from p(env, on)

        return block
    if isinstance(node, Out):
        value = _value(node.expr, filters)

        def out(env: Env, on: bool) -> Iterator[tuple[str, bool]]:
            yield _text(value(env)), on

        return out
    if isinstance(node, For):
        over, body, var = _value(node.over, filters), _render(node.body, filters), node.var

        def loop(env: Env, on: bool) -> Iterator[tuple[str, bool]]:
            items = over(env) or ()
            if not isinstance(items, (Messages, tuple, list)):
                return
            rest = iter(items)
            before, x, k = None, next(rest, None), 0
            while x is not None:
                after = next(rest, None)
                place = {"index": k + 1, "index0": k, "first": k == 0, "last": after is None, "previtem": before, "nextitem": after}
                yield from body({**env, var: x, "loop": place}, on)
                if isinstance(items, Messages):
                    yield TURN
                before, x, k = x, after, k + 1

        return loop
    if isinstance(node, Set):
        name, given = node.name, _value(node.expr, filters)

        def assign(env: Env, on: bool) -> Iterator[tuple[str, bool]]:
            env[name] = given(env)
            return iter(())

        return assign
    if isinstance(node, Generation):
        body = _render(node.body, filters)
        return lambda env, on: body(env, True)
    branches = [(_value(t, filters), _render(b, filters)) for t, b in node.branches]

    def choose(env: Env, on: bool) -> Iterator[tuple[str, bool]]:
        for test, b in branches:
            if test(env):
                yield from b(env, on)
                return

    return choose


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": lambda t: str(len(t))}


def compile_template(template: str, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of the template's variables that yields (piece, under the loss mask), and :data:`TURN` behind each message.

    ``messages`` may be any iterable of mappings; one loop goes over it, once.
    """
    tree = fold(parse(template), FILTERS if filters is None else filters)
    render, keep = _render(tree, FILTERS if filters is None else filters), largest_number(tree) + 1

    def run(**env: Any) -> Iterator[tuple[str, bool]]:
        if "messages" in env:
            env["messages"] = Messages(env["messages"], keep)
        return render(env, False)

    return run


# --- reading back -------------------------------------------------------------------------------------------------
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|<<TURN>> (?P<role>.*?) <<TEXT>> (?P<text>.*?) <</TURN>>", re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of what :data:`TEMPLATE` made."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        at = m.end()
        if m["role"] is not None:
            yield unescape(m["role"]), unescape(m["text"])
        elif m["user"] is not None:
            yield "user", unescape(m["user"])
        else:
            yield "assistant", unescape(m["assistant"])


# --- over a table -------------------------------------------------------------------------------------------------
TURNS = "conv_id long, last boolean, formatted string, mask array<struct<start: int, chars: int>>"


def format_turns(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted turns: conv_id, ``formatted`` and its loss ``mask`` (character spans), ``last`` for a conversation's last.

    A conversation's text is what its rows say one after the other; the rows of a conversation stand in order within one
    partition.  What ``template`` says outside its loop over messages is part of the first or last row.  Rows are taken by
    turn (null first), role and text; equal rows each count.  Null texts and roles are empty, a null conv_id is a
    conversation of its own, other columns don't matter.  Each conversation streams through a task turn by turn.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        out: list[tuple] = []
        for conv, said in groupby(_rows(batches), key=lambda r: r[0]):
            held: tuple | None = None  # the turn before: only the next one tells whether it is the last
            pieces: list[str] = []
            mask: list[dict] = []
            at = 0
            for piece, on in render(messages=({"role": role, "text": text} for _, role, text in said)):
                if on is None:
                    if held:
                        out.append((conv, False, *held))
                    held, pieces, mask, at = ("".join(pieces), mask), [], [], 0
                    if len(out) >= 1000:
                        yield frame(out)
                        out = []
                    continue
                if on and piece:
                    mask.append({"start": at, "chars": len(piece)})
                pieces.append(piece)
                at += len(piece)
            text, spans = held or ("", [])
            shifted = [{"start": len(text) + x["start"], "chars": x["chars"]} for x in mask]
            out.append((conv, True, text + "".join(pieces), spans + shifted))
        yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=["conv_id", "last", "formatted", "mask"])
        return pdf.astype({"conv_id": "Int64", "last": "bool"})

    return rows.mapInPandas(run, TURNS)


def _rows(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in batches:
        yield from zip(pdf["conv_id"].astype("object").where(pdf["conv_id"].notna(), None), pdf["role"], pdf["text"])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(turns: DataFrame) -> DataFrame:
    """What is read back from the formatted turns of each conversation: counts and digests of turns and of loss text."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, chars, loss_chars, all_sha, loss_sha = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for pdf in batches:
            out = []
            for conv, last, formatted, mask in zip(pdf["conv_id"].astype("object").where(pdf["conv_id"].notna(), None), pdf["last"], pdf["formatted"], pdf["mask"]):
                for role, text in read_turns(formatted):
                    n += 1
                    all_sha.update(f"{role}\n{text}\n".encode())
                for span in mask:
                    said = unescape(formatted[span["start"] : span["start"] + span["chars"]])
                    loss_chars += len(said)
                    loss_sha.update(said.encode())
                chars += len(formatted)
                if last:
                    out.append((conv, n, all_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars))
                    n, chars, loss_chars, all_sha, loss_sha = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            pdf = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield pdf.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})

    return turns.mapInPandas(run, DIGESTS)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(format_turns(rows.unionByName(probe)))


_PATTERN = "|".join(rf"{a}\\*{b}" for a, b in (("<", "s>"), ("<", "/s>"), (r"\[", r"INST\]"), (r"\[", r"/INST\]"), ("<", "<TURN>>"), ("<", "</TURN>>"), ("<", "<TEXT>>")))
SQL = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
x AS (SELECT *, CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6
    ELSE 29 + length(role) + len(regexp_extract_all(role, '{_PATTERN}')) END
  + length(text) + len(regexp_extract_all(text, '{_PATTERN}')) AS chars FROM r),
y AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(chars)::BIGINT AS formatted_chars FROM x GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM y
"""
