"""Syntax trees: expressions, relational operators and statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Expr:
    """An expression: its kind and what it consists of (see the parser for each kind's parts)."""

    kind: str
    parts: tuple = ()

    def __getitem__(self, i: int) -> Any:
        return self.parts[i]


@dataclass(frozen=True)
class Item:
    """One element of a select, group by or agg list."""

    expr: Expr
    name: str | None = None


@dataclass(frozen=True)
class Rel:
    """What stands after ``from``: kind (name, file, sql, json, values, query, call), its parts, alias and column names."""

    kind: str
    parts: tuple = ()
    alias: str | None = None
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Step:
    """One operator of a query and its arguments."""

    op: str
    args: tuple = ()


@dataclass(frozen=True)
class Query:
    source: Rel | None
    steps: tuple[Step, ...] = ()
    ctes: tuple = ()
    more: tuple[Rel, ...] = ()


@dataclass(frozen=True)
class Statement:
    kind: str
    parts: dict = field(default_factory=dict)


@dataclass(frozen=True)
class StageDef:
    """A step of a flow: its trigger (None: success of what it reads), configuration, engine and body."""

    name: str
    when: Expr | None
    config: dict
    on: str | None
    body: Query
    merged: tuple[str, ...] = ()


@dataclass(frozen=True)
class FlowDef:
    name: str
    params: tuple = ()  # of (name, type or None, default or None)
    depends: str | None = None
    when: Expr | None = None
    config: dict = field(default_factory=dict)
    stages: tuple[StageDef, ...] = ()
    text: str = ""
