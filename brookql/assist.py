"""Help for editors, and schemas that are kept as text: completion, hover, definitions, export of a catalog."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from .functions.methods import AGGREGATES, SCALARS
from .plans.lexer import QueryError, tokens
from .plans.parser import OPERATORS, STARTS, Parser
from .printer import type_name
from .session import Scope, Session


def _word(text: str, at: int) -> tuple[str, int]:
    start = at
    while start and (text[start - 1].isalnum() or text[start - 1] in "_"):
        start -= 1
    end = at
    while end < len(text) and (text[end].isalnum() or text[end] == "_"):
        end += 1
    return text[start:end], start


def columns_before(session: Session, text: str, at: int) -> dict[str, str]:
    """Columns, with types, of the query as it stands before ``at``: of the longest beginning that compiles."""
    cut = at
    while cut > 0:
        try:
            q = Parser(text[:cut]).statements()[-1].parts["query"]
            return {f.name: type_name(f.dataType) for f in session.query(q, Scope(session)).schema}
        except Exception:  # a text being written is mostly wrong
            cut = max((m.start() for m in re.finditer(r"\s\S", text[:cut])), default=0)
    return {}


def complete(session: Session, text: str, at: int) -> list[str]:
    """What may stand at ``at``: methods behind a dot, relations behind from and join, else columns, definitions and operators."""
    _, start = _word(text, at)
    prefix, before = text[start:at], text[:start].rstrip()
    if before.endswith("."):
        found = [*AGGREGATES, *SCALARS, *session.methods]
    elif re.search(r"\b(from|join)$", before) or before.endswith(","):
        names = [*session.relations, *session.models, *[t.name for t in session.spark.catalog.listTables() if not t.name.startswith("_brook_")]]
        found = names + (list(columns_before(session, text, start)) if before.endswith(",") else [])
    else:
        found = [*columns_before(session, text, start), *session.values, *session.functions, *session.partials, *OPERATORS, *STARTS]
    return sorted({f for f in found if f.startswith(prefix) and f != prefix})


def hover(session: Session, text: str, at: int) -> str | None:
    """A line about the name at ``at``."""
    word, start = _word(text, at)
    if word in session.models:
        m = session.models[word]
        return f"model {word}({', '.join(n for n, _ in m['params'])}){': ' + m['description'] if m.get('description') else ''}"
    if word in session.functions:
        return f"def {word}({', '.join(n for n, _ in session.functions[word]['params'])})"
    if word in session.flows:
        return f"flow {word}: {', '.join(s.name for s in session.flows[word].stages)}"
    if word in session.values:
        return f"val {word} = {session.values[word]}"
    if word in session.relations:
        return f"{word}: " + ", ".join(f"{f.name} {type_name(f.dataType)}" for f in session.frame(word).schema)
    columns = columns_before(session, text, start)
    if word in columns:
        return f"{word}: {columns[word]}"
    return f"method {word}" if word in AGGREGATES or word in SCALARS else None


def definition(text: str, at: int) -> int | None:
    """Where in ``text`` the name at ``at`` is defined."""
    word, _ = _word(text, at)
    found = tokens(text)
    for a, b in zip(found, found[1:]):
        if a.text in ("model", "def", "val", "type", "flow", "stage", "with") and a.kind == "name" and b.text == word:
            return b.at
        if a.text == "as" and b.text == word:
            return b.at
    return None


# --- catalogs as text -------------------------------------------------------------------------------------------------
def export_catalog(spark: SparkSession, schema: str = "default") -> str:
    """The tables of a schema as bound types, and Spark's functions as native definitions: text to compile against without the tables."""
    lines = []
    for t in sorted(spark.catalog.listTables(schema), key=lambda t: t.name):
        if t.name.startswith("_brook_") or t.isTemporary:
            continue
        fields = "; ".join(f"`{f.name}`: {type_name(f.dataType)}" for f in spark.table(f"{schema}.{t.name}").schema)
        lines.append(f"type {t.name} in {schema} = {{ {fields} }}")
    names = sorted({r[0] for r in spark.sql("show functions").collect() if re.fullmatch(r"[a-z_]\w*", r[0])} - OPERATORS - STARTS)
    return "\n".join([*lines, *[f"def {n}(x: any) = native" for n in names]])


def use_catalog(session: Session, text: str) -> list[str]:
    """Empty frames with the exported schemas stand for tables, so that queries compile offline; their names."""
    session.run(text)
    made = []
    for name in session.bound_types:
        if name not in session.relations:
            schema = ", ".join(f"`{f}` {_spark_type(t)}" for f, t in session.types[name])
            session.register(name, session.spark.createDataFrame([], schema))
            made.append(name)
    if not made:
        raise QueryError("the text has no types that are bound to a schema")
    return made


def _spark_type(t: str) -> str:
    from .plans.render import type_sql

    return "int" if t == "int" else type_sql(t)
