"""Results as text: a box with types, tab-separated values, JSON lines or one JSON array."""

from __future__ import annotations

import datetime
import decimal
import json
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T


def plain(value: Any) -> Any:
    """A value as JSON has it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, (datetime.date, datetime.datetime, datetime.time, datetime.timedelta)):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def cell(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(plain(value), ensure_ascii=False) if isinstance(value, (list, dict, Row)) else str(value)


def type_name(t: T.DataType) -> str:
    """The language's name of a type."""
    if isinstance(t, T.ArrayType):
        return f"array({type_name(t.elementType)})"
    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision},{t.scale})"
    return {"bigint": "long", "timestamp_ntz": "timestamp"}.get(t.simpleString(), t.simpleString())


def box(df: DataFrame, limit: int = 40, width: int = 80) -> str:
    """At most ``limit`` rows in a box; longer cells are cut at ``width``."""
    rows = df.limit(limit + 1).collect()
    more, rows = len(rows) > limit, rows[:limit]
    names, types = df.columns, [type_name(f.dataType) for f in df.schema]
    cells = [[c if len(c) <= width else c[: width - 1] + "…" for c in map(cell, r)] for r in rows]
    widths = [max([len(n), len(t), *[len(r[i]) for r in cells]]) for i, (n, t) in enumerate(zip(names, types))]
    foot = f"{len(rows)}{'+' if more else ''} rows"
    if widths and sum(widths) + 3 * len(widths) - 1 < len(foot) + 2:
        widths[-1] += len(foot) + 2 - (sum(widths) + 3 * len(widths) - 1)
    right = [isinstance(f.dataType, (T.NumericType,)) for f in df.schema]

    def line(items: list[str], how: list[str]) -> str:
        return "│" + "│".join(f" {format(x, f'{h}{w}')} " for x, h, w in zip(items, how, widths)) + "│"

    def rule(a: str, b: str, c: str) -> str:
        return a + b.join("─" * (w + 2) for w in widths) + c

    middle = ["^"] * len(names)
    out = [rule("┌", "┬", "┐"), line(names, middle), line(types, middle), rule("├", "┼", "┤")]
    out += [line(r, [">" if x else "<" for x in right]) for r in cells]
    inner = sum(widths) + 3 * len(widths) - 1
    return "\n".join([*out, rule("├", "┴", "┤"), f"│ {foot:<{inner - 2}} │", "└" + "─" * inner + "┘"])


def json_lines(df: DataFrame) -> str:
    return "\n".join(json.dumps(plain(r), ensure_ascii=False) for r in df.collect())


def show(df: DataFrame, how: str = "box", limit: int = 40) -> str:
    """``how``: box, tsv, jsonl or json."""
    if how == "box":
        return box(df, limit)
    rows = df.limit(limit).collect()
    if how == "tsv":
        return "\n".join("\t".join(x.replace("\t", " ").replace("\n", " ") for x in r) for r in [df.columns, *[list(map(cell, r)) for r in rows]])
    if how == "json":
        return json.dumps([plain(r) for r in rows], ensure_ascii=False)
    if how == "jsonl":
        return "\n".join(json.dumps(plain(r), ensure_ascii=False) for r in rows)
    raise ValueError(f"no such form: {how}")
