"""Sessions: text in the flow language to DataFrames, with models, functions, constants, tests and saved tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commands, printer
from .flow.model import check_flow
from .operators import dml
from .operators import relational as ops
from .plans.lexer import QueryError
from .plans.nodes import Expr, FlowDef, Item, Query, Rel, Statement, Step
from .plans.parser import Parser, parse
from .plans.render import Renderer, bind, quote, type_sql
from .sources import files
from .sql_session import SqlRunner
from .streaming import subscribe as streams

#: Names that a type may extend without being defined, and engines that a definition may be for.
_BASE_TYPES = {"any", "string", "int", "long", "float", "double", "decimal", "boolean", "date", "timestamp", "array", "map", "json", "binary"}
_DIALECTS = {"spark", "duckdb", "trino", "snowflake", "hive"}


class TestFailure(AssertionError):
    """A ``test`` of a query doesn't hold."""


@dataclass
class State:
    """A frame on its way through operators; ``keys`` while it is grouped, ``having`` until the aggregates are known."""

    df: DataFrame
    keys: list[tuple[str, str]] | None = None
    having: tuple[Expr, ...] = ()


class Scope:
    def __init__(self, session: Session) -> None:
        self.session, self.values, self.relations = session, dict(session.values), {}
        self.functions, self.methods, self.aliases, self.active = session.functions, session.methods, set(), frozenset()
        self.views: list[str] = []
        self.qualified: dict[tuple[str, str], str] = {}  # columns of an AS-OF join by alias

    def child(self, values: dict[str, str]) -> Scope:
        out = Scope(self.session)
        out.values, out.relations, out.aliases, out.active, out.views = {**self.values, **values}, dict(self.relations), set(self.aliases), self.active, self.views
        out.qualified = dict(self.qualified)
        return out

    def view(self, df: DataFrame) -> str:
        """A view for one analysis; :meth:`Session.step` drops it once the step's frame is made."""
        name = f"_brook_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(name)
        self.views.append(name)
        return name

    def close(self) -> None:
        while self.views:
            self.session.spark.catalog.dropTempView(self.views.pop())

    def subquery(self, q: Query) -> str:
        """SQL of a subquery: a select over a view, with filters that may look at the outer frame."""
        inner = self.child({})
        base = self.session.source(q, inner)
        early = []
        steps = list(q.steps)
        while steps and steps[0].op == "where":
            early.append(steps.pop(0).args[0])
        named = q.source.alias or (q.source.parts[0][-1] if q.source and q.source.kind == "name" else None)
        view = self.view(base)
        name = named or view
        inner.aliases.add(name)
        if len(steps) > 1 or steps and steps[0].op not in ("select", "agg", "count"):
            inner.views = []
            whole = self.session.run_steps(State(base.alias(name)), q.steps, inner)
            return f"select * from {self.view(whole)}"
        r = Renderer(inner, None)
        what = "*" if not steps else "count(1)" if steps[0].op == "count" else ", ".join(r(i.expr) for i in steps[0].args[-1])
        distinct = "distinct " if steps and steps[0].op == "select" and steps[0].args[0] else ""
        return f"select {distinct}{what} from {view} as {quote(name)}" + (f" where {' and '.join(map(r, early))}" if early else "")


class Session:
    """Compiles and runs statements; what they define stays for the next.

    ``most_rows`` bounds what a test's ``_.rows``, ``_.json`` and ``_.output`` may bring to the driver; beyond it they fail.
    ``path``: folders where imports are looked for.  ``store``: keeps runs of flows (in memory by default).
    """

    def __init__(self, spark: SparkSession, most_rows: int = 10_000, path: tuple[str, ...] = (".",), store: Any = None) -> None:
        self.spark, self.most_rows, self.path = spark, most_rows, path
        self.values: dict[str, str] = {}
        self.relations: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        self.models: dict[str, dict] = {}
        self.functions: dict[str, dict] = {}
        self.partials: dict[str, dict] = {}
        self.methods: dict[str, list[dict]] = {}
        self.types: dict[str, list[tuple[str, str]]] = {}
        self.bound_types: dict[str, tuple[str, ...]] = {}
        self.flows: dict[str, FlowDef] = {}
        self.tools: dict[str, Callable[..., Any]] = {}
        self.connectors: dict[str, Any] = {}
        self.connector: str | None = None
        self.sinks: dict[str, Callable[..., None]] = {}
        self.prepared: dict[str, list] = {}
        self.settings: dict[str, str] = {}
        self.package = ""
        self.store = store
        self.last: DataFrame | None = None
        self.open_models: list[str] = []
        self.streams: list[Any] = []

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """Name a frame, or a function that opens it when it is first read."""
        self.relations[name] = df

    def frame(self, name: str) -> DataFrame:
        df = self.relations[name]
        if not isinstance(df, DataFrame):
            df = self.relations[name] = df()
        return df

    def run(self, text: str) -> DataFrame | None:
        """Run all statements of the flow language; the frame of the last query, if there is one."""
        out = None
        for s in parse(text):
            result = self.statement(s)
            out = result if result is not None else out
        return out

    def sql(self, text: str, hive: bool = False) -> DataFrame | None:
        """Run SQL statements; the frame of the last one."""
        out = SqlRunner(self, hive).run(text)
        self.last = out if out is not None else self.last
        return out

    def run_file(self, path: str) -> DataFrame | None:
        """Run a file: ``.sql``, ``.hive.sql``, Markdown with fenced queries, or the flow language."""
        text = files.text(self.spark, path)
        if path.endswith(".sql"):
            return self.sql(text, hive=path.endswith(".hive.sql"))
        if path.endswith(".md"):
            out = None
            for kind, body in files.fenced(text):
                found = self.sql(body) if kind == "sql" else self.run(body)
                out = found if found is not None else out
            return out
        return self.run(text)

    @contextmanager
    def views(self, wanted: set[str]) -> Iterator[None]:
        """The session's relations and models without parameters among ``wanted`` as views, while SQL is analysed."""
        made = []
        for name in wanted & (set(self.relations) | {n for n, m in self.models.items() if not m["params"]}):
            if re.fullmatch(r"\w+", name):
                had = self.spark.catalog.tableExists(name) and any(t.name == name and t.isTemporary for t in self.spark.catalog.listTables())
                df = self.frame(name) if name in self.relations else self.model(name, [], Scope(self))
                if not had:
                    df.createOrReplaceTempView(name)
                    made.append(name)
        try:
            yield
        finally:
            for name in made:
                self.spark.catalog.dropTempView(name)

    def statement(self, s: Statement) -> DataFrame | None:
        p = s.parts
        if s.kind == "query":
            self.last = self.query(p["query"], Scope(self))
            return self.last
        if s.kind == "model":
            self.models[p["name"]] = p | {"package": self.package}
        elif s.kind == "val":
            self.values[p["name"]] = Renderer(Scope(self), None)(p["expr"])
        elif s.kind == "table":
            self.relations[p["name"]] = self.table(p["rows"], p["columns"])
        elif s.kind == "def":
            (self.partials if "steps" in p else self.functions if not p.get("native") else {})[p["name"]] = p
        elif s.kind == "type":
            self.define_type(p)
        elif s.kind == "flow":
            check_flow(p["flow"])
            self.flows[p["flow"].name] = p["flow"]
        elif s.kind == "import":
            self.import_(p)
        elif s.kind == "execute":
            return self.sql(p["sql"])
        elif s.kind == "explain":
            df = self.sql(p["sql"]) if "sql" in p else self.query(p["query"], Scope(self))
            return self.explained(df)
        elif s.kind == "use":
            if p["what"] == "connector":
                if p["name"][0] not in self.connectors:
                    raise QueryError(f"no connector is called {p['name'][0]}")
                self.connector = p["name"][0]
            else:
                self.spark.catalog.setCurrentDatabase(".".join(p["name"]))
        elif s.kind == "show_query":
            return self.spark.createDataFrame([(self.models[p["name"]]["text"],)], "query string")
        elif s.kind == "show":
            self.last = self.run_steps(State(commands.show(self, p)), p["steps"], Scope(self))
            return self.last
        return None

    def explained(self, df: DataFrame) -> DataFrame:
        """One row: the formatted physical plan."""
        name = f"_brook_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(name)
        try:
            text = self.spark.sql(f"explain formatted select * from {name}").first()[0]
        finally:
            self.spark.catalog.dropTempView(name)
        return self.spark.createDataFrame([(text,)], "plan string")

    def define_type(self, p: dict) -> None:
        """Fields and methods of a type, those of what it extends first; an equal definition of one type and dialect is replaced."""
        name, parent = p["name"], p["extends"]
        if parent and parent not in self.types and parent not in _BASE_TYPES:
            raise QueryError(f"{name} extends {parent}, which isn't there")
        self.types[name] = [*self.types.get(parent, []), *p["fields"]]
        dialect = p["in"][-1] if p["in"] and p["in"][-1] in _DIALECTS else None
        if p["in"] and dialect is None:
            self.bound_types[name] = p["in"]
        inherited = [(n, m) for n, ms in self.methods.items() for m in ms if m["type"] == parent] if parent else []
        for n, m in [*inherited, *[(m["name"], m) for m in p["methods"] if not m.get("native")]]:
            m = m | {"type": name, "in": m.get("in") or dialect}
            self.methods[n] = [x for x in self.methods.get(n, []) if (x["type"], x["in"]) != (name, m["in"])] + [m]

    def import_(self, p: dict) -> None:
        """``import a.b [as c] [from 'file']``: all definitions of a file, or the one that is named."""
        *package, last = p["path"]
        tries = [p["from"]] if p["from"] else [f"{'/'.join(x)}{e}" for x in (p["path"], package) if x for e in (".wv", ".flow", ".md")]
        for folder in self.path:
            for name in tries:
                path = name if re.match(r"(\w+:)?/", name) else f"{folder}/{name}"
                if files.exists(self.spark, path):
                    other = Session(self.spark, path=(path.rsplit("/", 1)[0], *self.path))
                    other.relations, other.package = dict(self.relations), ".".join(package)
                    other.run_file(path)
                    return self.take_from(other, last, p["as"])
        raise QueryError(f"can't find {'.'.join(p['path'])} in {', '.join(tries)}")

    def take_from(self, other: Session, name: str, alias: str | None) -> None:
        stores = ("values", "relations", "models", "functions", "partials", "types", "flows")
        holders = [s for s in stores if name in getattr(other, s) and not (s == "relations" and name in self.relations)]
        for s in stores:
            mine, theirs = getattr(self, s), getattr(other, s)
            if not holders:
                mine |= {k: v for k, v in theirs.items() if s != "relations" or k not in mine}
            elif s in holders:
                value = theirs[name]
                mine[alias or name] = value | {"name": alias or name} if isinstance(value, dict) else value
        if not holders or "types" in holders:
            for n, ms in other.methods.items():
                self.methods[n] = [m for m in ms if not holders or m["type"] == name] + self.methods.get(n, [])

    # --- sources --------------------------------------------------------------------------------------------------
    def table(self, rows: list[list[Expr]], columns: list) -> DataFrame:
        width = max([len(r) for r in rows], default=len(columns))
        columns = columns or [(f"col{i}", None) for i in range(width)]
        r = Renderer(Scope(self), None)
        if not rows:
            return self.spark.createDataFrame([], ", ".join(f"{n} {type_sql(t or 'string')}" for n, t in columns))
        df = self.spark.sql("select * from values " + ", ".join("(" + ", ".join(map(r, row)) + ")" for row in rows)).toDF(*[n for n, _ in columns])
        return df.select(*[F.col(n).cast(type_sql(t)).alias(n) if t else F.col(n) for n, t in columns])

    def source(self, q: Query, scope: Scope) -> DataFrame:
        for name, inner in q.ctes:
            scope.relations[name] = self.query(inner, scope.child({}))
        if q.source is None:
            return self.spark.range(1).select()
        df = self.relation(q.source, scope)
        for rel in q.more:
            df = df.crossJoin(self.relation(rel, scope))
        return df

    def relation(self, rel: Rel, scope: Scope) -> DataFrame:
        name = rel.alias
        if rel.kind == "file":
            path = rel.parts[0]
            if path.endswith((".sql", ".wv", ".flow", ".md")):
                df = self.nested(path)
            else:
                df = files.read(self.spark, path)
        elif rel.kind == "sql":
            df = self.nested_sql(Renderer(scope, None)(Expr("interp", ("sql", rel.parts[0])))[1:-1], scope)
        elif rel.kind == "json":
            df = files.json_text(self.spark, rel.parts[0])
        elif rel.kind == "run_flow":
            df = self.run_flow(rel.parts[0], rel.parts[1], scope)
        elif rel.kind == "tool":
            df = self.call_tool(rel.parts[0], rel.parts[1], scope)
        elif rel.kind == "values":
            df = self.table(rel.parts[0], [(c, None) for c in rel.columns])
        elif rel.kind == "query":
            df = self.query(rel.parts[0], scope.child({}))
        elif rel.kind == "call":
            n, args = rel.parts
            if n[-1] == "subscribe" and len(n) > 1:
                given = {k: v[0] for k, v in args}
                df = streams.subscribed(self.relation(Rel("name", (n[:-1],)), scope), **given)
            elif n[-1] in self.models:
                df = self.model(n[-1], args, scope)
            elif n[-1] == "unnest":
                r = Renderer(scope, None)
                df = self.spark.sql(f"select explode({r(args[0][1])})")
            else:
                r = Renderer(scope, None)
                df = self.spark.sql(f"select * from {'.'.join(n)}({', '.join(r(a) for _, a in args)})")
        else:
            n = rel.parts[0] if rel.kind == "name" else tuple(self.text_of(rel.parts[0], scope).split("."))
            full = ".".join(n)
            name = name or n[-1]
            if full in scope.relations:
                df = scope.relations[full]
            elif full in self.relations:
                df = self.frame(full)
            elif full in self.models:
                df = self.model(full, [], scope)
            elif len(n) > 1 and n[0] in self.connectors:
                df = self.connectors[n[0]].table(self.spark, ".".join(n[1:]))
            elif self.connector and not self.spark.catalog.tableExists(full):
                df = self.connectors[self.connector].table(self.spark, full)
            elif len(n) == 1 and full in self.bound_types and not self.spark.catalog.tableExists(full):
                df = self.spark.table(".".join([*self.bound_types[full], full]))
            else:
                df = self.spark.table(".".join(map(quote, n)))
        if rel.columns and rel.kind != "values":
            df = df.toDF(*rel.columns)
        if name:
            scope.aliases.add(name)
            df = df.alias(name)
        return df

    def nested(self, path: str) -> DataFrame:
        """The last query of another file, which sees what is defined here and leaves nothing behind."""
        inner = Session(self.spark, self.most_rows, (path.rsplit("/", 1)[0], *self.path))
        for k in ("values", "relations", "models", "functions", "partials", "methods", "types", "flows", "connectors", "tools"):
            setattr(inner, k, dict(getattr(self, k)))
        found = inner.run_file(path)
        if found is None:
            raise QueryError(f"{path} has no query")
        return found

    def nested_sql(self, text: str, scope: Scope) -> DataFrame:
        inner = {k: v for k, v in scope.relations.items() if re.fullmatch(r"\w+", k)}
        outer = {k: self.relations.get(k) for k in inner}
        self.relations.update(inner)
        try:
            return SqlRunner(self).run(text)
        finally:
            for k, v in outer.items():
                self.relations.pop(k)
                if v is not None:
                    self.relations[k] = v

    def text_of(self, text: str, scope: Scope) -> str:
        """A name with its ${} parts, which are constants, put in."""
        return re.sub(r"\$\{(.*?)\}", lambda m: str(self.constant(m[1], scope)), text)

    def constant(self, text: str, scope: Scope) -> Any:
        return self.spark.sql(f"select {Renderer(scope, None)(Parser(text).expr())}").first()[0]

    def call_tool(self, name: tuple[str, ...], args: list, scope: Scope) -> DataFrame:
        """One row (connector, tool, status, content) of a registered tool; a failure is its status."""
        full = ".".join(name)
        if full not in self.tools:
            raise QueryError(f"no such tool: {full}")
        given = {k or f"arg{i}": self.spark.sql(f"select {Renderer(scope, None)(v)}").first()[0] for i, (k, v) in enumerate(args)}
        try:
            status, content = "ok", self.tools[full](**given)
        except Exception as e:  # what a tool raises is its result
            status, content = "error", str(e)
        content = content if isinstance(content, str) else json.dumps(printer.plain(content))
        return self.spark.createDataFrame([(name[0], name[-1], status, content)], "connector string, tool string, status string, content string")

    def run_flow(self, name: str, args: list, scope: Scope) -> DataFrame:
        from .flow.run import FlowRunner

        return FlowRunner(self).run(name, args).summary(self.spark)

    def model(self, name: str, args: list, scope: Scope) -> DataFrame:
        if name in self.open_models:
            raise QueryError(f"model {name} reads itself")
        m = self.models[name]
        r = Renderer(scope, None)
        inner = Scope(self).child({p: r(v) for p, v in bind(name, m["params"], args).items()})
        self.open_models.append(name)
        try:
            return self.query(m["query"], inner)
        finally:
            self.open_models.pop()

    # --- operators ------------------------------------------------------------------------------------------------
    def query(self, q: Query, scope: Scope) -> DataFrame:
        if q.steps and q.steps[-1].op == "delete":
            return self.delete(q, scope)
        return self.run_steps(State(self.source(q, scope)), q.steps, scope)

    def run_steps(self, state: State, steps: tuple | list, scope: Scope) -> DataFrame:
        own = scope.views = []
        try:
            for i, step in enumerate(steps):
                if step.op == "delete":
                    if i + 1 < len(steps):
                        raise QueryError("nothing can follow delete")
                    raise QueryError("delete takes a table and filters only")
                state = self.step(state, step, scope)
            return self.ungrouped(state, scope)
        finally:
            scope.views = own
            scope.close()

    def delete(self, q: Query, scope: Scope) -> DataFrame:
        """Delete the rows that the filters leave from the table that is read."""
        if q.source is None or q.source.kind != "name" or q.more or any(x.op != "where" for x in q.steps[:-1]):
            raise QueryError("delete takes a table and filters only")
        name = ".".join(q.source.parts[0])
        if name in self.relations or name in self.models or name in scope.relations:
            raise QueryError(f"delete needs a table, and {name} is a query")
        df = self.source(q, scope)
        try:
            r = Renderer(scope, df)
            condition = " and ".join(f"coalesce({r(x.args[0])}, false)" for x in q.steps[:-1])
            return dml.delete(self.spark, name, condition or None, q.source.alias)
        finally:
            scope.close()

    def ungrouped(self, s: State, scope: Scope) -> DataFrame:
        return ops.first_of_group(s.df, s.keys) if s.keys is not None and not s.having else self.aggregate(s, None, scope) if s.keys is not None else s.df

    def named(self, items: list[Item], r: Renderer) -> list[tuple[str | None, str]]:
        return [(i.name or self.label(i.expr), r(i.expr)) for i in items]

    def label(self, e: Expr) -> str | None:
        if e.kind == "name":
            return e[0]
        if e.kind in ("dot", "method"):
            inner = self.label(e[0])
            return e[1] if e[0].kind == "name" and e[0][0] in ("_",) else f"{e[1]}({inner})" if e[1] in ("sum", "avg", "min", "max", "count_distinct", "median") else e[1]
        return None

    @staticmethod
    def columns(pairs: list[tuple[str | None, str]]) -> list[Any]:
        return [F.expr(x).alias(n) if n and not x.endswith("*") else F.expr(x) for n, x in pairs]

    def aggregate(self, s: State, items: list[Item] | None, scope: Scope, keep_keys: bool = True) -> DataFrame:
        """Keys and aggregates, filtered by hidden columns for what ``where`` said of the group."""
        r = Renderer(scope, s.df, s.keys)
        keys = s.keys or []
        pairs = self.named(items or [], r)
        if items is None:
            names = {n for n, _ in keys}
            pairs = [(c, f"any_value(`{c}`)") for c in s.df.columns if c not in names]
        hidden = [(f"_having{i}", r(e)) for i, e in enumerate(s.having)]
        if not keep_keys:  # a select over the group: its items may be keys
            by_expr = {x: n for n, x in keys}
            extra = [(f"_agg{i}", x) for i, (_, x) in enumerate(pairs) if x not in by_expr]
            grouped = s.df.groupBy(*[F.expr(x).alias(n) for n, x in keys])
            df = grouped.agg(*[F.expr(x).alias(n) for n, x in [*extra, *hidden]] or [F.lit(1)])
            for n, _ in hidden:
                df = df.where(n)
            at = {x: n for n, x in extra} | by_expr
            return df.select(*[F.col(f"`{at[x]}`").alias(n or x) for n, x in pairs])
        made = self.columns(pairs) + [F.expr(x).alias(n) for n, x in hidden]
        df = s.df.groupBy(*[F.expr(x).alias(n) for n, x in keys]).agg(*made) if keys else s.df.agg(*made)
        for n, _ in hidden:
            df = df.where(n).drop(n)
        return df

    def step(self, s: State, step: Step, scope: Scope) -> State:
        op, a = step.op, step.args
        r = Renderer(scope, s.df, s.keys)
        if s.keys is not None:
            if op == "where":
                return State(s.df, s.keys, (*s.having, a[0]))
            if op == "agg":
                return State(self.aggregate(s, a[0], scope))
            if op == "select":
                return State(self.aggregate(s, a[1], scope, keep_keys=False))
            s = State(self.ungrouped(s, scope))
            r = Renderer(scope, s.df)
        df = s.df
        if op == "where":
            return State(df.where(r(a[0])))
        if op == "select":
            if any(r.aggregates(i.expr) for i in a[1]):
                return State(df.agg(*self.columns(self.named(a[1], r))))
            out = df.select(*self.columns(self.named(a[1], r)))
            return State(out.distinct() if a[0] else out)
        if op == "add":
            return State(df.select("*", *self.columns(self.named(a[0], r))))
        if op == "prepend":
            return State(df.select(*self.columns(self.named(a[0], r)), "*"))
        if op == "transform":
            return State(df.withColumns({n: F.expr(x) for n, x in self.named(a[0], r)}))
        if op == "exclude":
            return State(df.drop(*a[0]))
        if op == "rename":
            return State(ops.rename(df, a[0]))
        if op == "shift":
            return State(ops.shift(df, *a))
        if op == "group":
            return State(df, [(n or f"_{k}", x) for k, (n, x) in enumerate(self.named(a[0], r), 1)])
        if op == "agg":
            return State(df.agg(*self.columns(self.named(a[0], r))))
        if op == "count":
            return State(df.agg(F.count(F.lit(1)).alias("count")))
        if op == "dedup":
            return State(df.distinct())
        if op == "pivot":
            on = [(k, None if v is None else [e[0] for e in v]) for k, v in a[0]]
            return State(ops.pivot(df, on, [(n or x, x) for n, x in self.named(a[1], r)], [(n or x, x) for n, x in self.named(a[2], r)]))
        if op == "unpivot":
            return State(ops.unpivot(df, *a))
        if op == "join":
            return State(self.join(df, *a, scope))
        if op in ("concat", "intersect", "except", "union"):
            inner = scope.child({})
            inner.views = []
            other = self.query(a[0], inner)
            if op == "concat":
                return State(df.union(other))
            if op == "union":
                return State(df.union(other) if a[1] else df.union(other).distinct())
            return State({("intersect", True): df.intersectAll, ("intersect", False): df.intersect, ("except", True): df.exceptAll, ("except", False): df.subtract}[op, a[1]](other))
        if op == "order":
            keys = []
            for e, desc, nulls in a[0]:
                at = f"`{df.columns[int(e[0]) - 1]}`" if e.kind == "num" else r(e)
                c = F.expr(at)
                keys.append({(False, "last"): c.asc_nulls_last, (False, "first"): c.asc_nulls_first, (True, "last"): c.desc_nulls_last, (True, "first"): c.desc_nulls_first}[desc, nulls]())
            return State(df.orderBy(*keys))
        if op == "limit":
            return State(df.limit(int(r(a[0]))))
        if op == "offset":
            return State(df.offset(int(r(a[0]))))
        if op == "sample":
            return State(ops.sample(df, *a))
        if op == "describe":
            return State(commands.describe(df))
        if op == "name_as":
            self.relations[a[0]] = scope.relations[a[0]] = df
            return State(df)
        if op == "apply":
            p = self.partials.get(a[0])
            if p is None:
                raise QueryError(f"no such partial query: {a[0]}")
            if a[0] in scope.active:
                raise QueryError(f"{a[0]} applies itself")
            inner = scope.child({n: r(v) for n, v in bind(a[0], p["params"], a[1]).items()})
            inner.active = scope.active | {a[0]}
            return State(self.run_steps(State(df), p["steps"], inner))
        if op == "test":
            self.test(df, a[0], scope)
            return State(df)
        if op == "debug":
            self.run_steps(State(df), a[0], scope).show()
            return State(df)
        if op in ("save", "append"):
            target, file, cols, options = a
            if df.isStreaming:
                self.streams.append(streams.start(df, target, file, options))
                return State(df)
            if file:
                df = df.toDF(*cols) if cols else df
                files.write(df, target, "overwrite" if op == "save" else "append", options)
                return State(df)
            if op == "save":
                return State(dml.replace_table(df.toDF(*cols) if cols else df, target, options))
            return State(dml.append(df, target, cols))
        raise QueryError(f"can't run {op} here")

    def join(self, df: DataFrame, how: str, asof: bool, rel: Rel, on: Expr | None, using: list[str] | None, scope: Scope) -> DataFrame:
        if rel.kind == "call" and rel.parts[0] == ("unnest",):
            x = Renderer(scope, df)(rel.parts[1][0][1])
            return df.select("*", F.expr(f"explode({x})").alias(rel.columns[0] if rel.columns else rel.alias or "col"))
        other = self.relation(rel, scope)
        if asof:
            return self.asof(df, other, on, how, scope, rel.alias or (rel.parts[0][-1] if rel.kind == "name" else None))
        if using:
            if using == ["*"]:
                using = [c for c in df.columns if c in other.columns]
            return df.join(other, using, how) if using else df.crossJoin(other)
        if on is None:
            return df.crossJoin(other)
        return df.join(other, F.expr(Renderer(scope, None)(on)), how)

    def side(self, e: Expr, df: DataFrame, other: DataFrame, name: str | None) -> str:
        """Which side of a join an expression's columns belong to: by alias, or by the one side that has them."""
        found: set[str] = set()

        def look(x: Any) -> None:
            if isinstance(x, Expr):
                if x.kind == "dot" and x[0].kind == "name" and x[1] not in df.columns + other.columns:
                    return look(x[0])
                if x.kind == "dot" and x[0].kind == "name":
                    found.add("right" if x[0][0] == name else "left")
                elif x.kind == "name":
                    here = {k for k, d in (("left", df), ("right", other)) if x[0] in d.columns}
                    found.update(here)
                else:
                    look(x.parts)
            elif isinstance(x, (tuple, list)):
                for y in x:
                    look(y)

        look(e)
        return found.pop() if len(found) == 1 else "both"

    def asof(self, df: DataFrame, other: DataFrame, on: Expr, how: str, scope: Scope, name: str | None = None) -> DataFrame:
        if on is None:
            raise QueryError("an asof join needs a condition")
        parts: list[Expr] = []

        def split(e: Expr) -> None:
            if e.kind == "bin" and e[0] == "and":
                split(e[1])
                split(e[2])
            else:
                parts.append(e)

        split(on)
        r, equal, times = Renderer(scope, None), [], None
        turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
        for e in parts:
            if e.kind != "bin" or e[0] not in ("=", *turned):
                raise QueryError("an asof join takes equalities and one inequality")
            x, y, op = e[1], e[2], e[0]
            sides = self.side(x, df, other, name), self.side(y, df, other, name)
            if sides == ("right", "left"):
                x, y, op = y, x, turned.get(op, op)
            elif sides != ("left", "right"):
                raise QueryError("each comparison of an asof join has one side's columns on each side; qualify names that both have")
            if op == "=":
                equal.append((r(x), r(y)))
            elif times is None:
                times = (r(x), turned[op], r(y))
            else:
                raise QueryError("an asof join has one inequality")
        left = set(scope.aliases)
        if times is None:
            raise QueryError("an asof join needs an inequality")
        # names that both sides have get a number on the right, as the aliases are gone behind the join
        new = []
        for c in other.columns:
            k = 1
            while (n := c if k == 1 and c not in df.columns else f"{c}_{k}") in [*df.columns, *new]:
                k += 1
            new.append(n)
        for a in left - {name}:
            scope.qualified |= {(a, c): c for c in df.columns if (a, c) not in scope.qualified}
        if name:
            scope.qualified |= {(name, c): n for c, n in zip(other.columns, new)}
        out = ops.asof_join(df, other, equal, times, how)
        return out.toDF(*df.columns, *new)

    # --- tests ----------------------------------------------------------------------------------------------------
    def rows(self, df: DataFrame) -> list:
        found = df.limit(self.most_rows + 1).collect()
        if len(found) > self.most_rows:
            raise QueryError(f"a test looks at {self.most_rows} rows at most: give the session a larger most_rows, or limit the query")
        return found

    def test(self, df: DataFrame, e: Expr, scope: Scope) -> None:
        """Hold a result against an expression over ``_.size``, ``_.columns``, ``_.rows``, ``_.json`` and ``_.output``."""
        views = {
            "size": df.count,
            "columns": lambda: list(df.columns),
            "rows": lambda: [printer.plain(list(row)) for row in self.rows(df)],
            "json": lambda: "\n".join(json.dumps(printer.plain(row), ensure_ascii=False) for row in self.rows(df)),
            "output": lambda: printer.box(df, self.most_rows),
        }

        def value(x: Expr) -> Any:
            if x.kind == "dot" and x[0] == Expr("name", ("_",)) and x[1] in views:
                return views[x[1]]()
            if x.kind == "array":
                return [value(y) for y in x[0]]
            return printer.plain(self.spark.sql(f"select {Renderer(scope, None)(x)}").first()[0])

        def same(x: Any, y: Any) -> bool:
            return x.strip() == y.strip() if isinstance(x, str) and isinstance(y, str) else x == y

        if e.kind == "should":
            what, a, b, negate = e.parts
            x, y = value(a), value(b)
            ok = same(x, y) if what == "be" else y in x
            ok = ok != negate
        elif e.kind == "is_null":
            x, y = value(e[0]), None
            ok = (x is None) != e[1]
        elif e.kind == "bin" and e[0] in ("=", "!=", "<", "<=", ">", ">="):
            x, y = value(e[1]), value(e[2])
            ok = {"=": lambda: same(x, y), "!=": lambda: not same(x, y), "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[e[0]]()
        else:
            x, y = value(e), True
            ok = x is True
        if not ok:
            raise TestFailure(f"{x!r} against {y!r}")
