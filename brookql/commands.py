"""Inspection: show and describe as frames."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.lexer import QueryError
from .plans.nodes import Rel
from .printer import type_name

if TYPE_CHECKING:
    from .session import Session


def describe(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, type_name(f.dataType)) for f in df.schema], "column_name string, column_type string")


def show(session: Session, p: dict) -> DataFrame:
    """Rows for ``show ...``; the first column is called name, but for models, where it is the first of four."""
    from .session import Scope

    spark, what = session.spark, p["what"]
    if what == "models":
        rows = [(m["name"], ", ".join(n for n, _ in m["params"]), m.get("description", ""), m.get("package", "")) for m in session.models.values()]
        df = spark.createDataFrame(rows, "name string, args string, description string, package_name string")
    elif what == "flows":
        df = spark.createDataFrame([(f.name, len(f.stages), str(f.config.get("schedule", ("", []))[0])) for f in session.flows.values()], "name string, stages int, schedule string")
    elif what == "columns":
        if p["in"] is None:
            raise QueryError("show columns needs a table")
        df = session.relation(Rel("name", (p["in"],)), Scope(session))
        df = spark.createDataFrame([(f.name, type_name(f.dataType), f.nullable) for f in df.schema], "name string, type string, nullable boolean")
    elif what == "tables":
        df = spark.sql("show tables" + (f" in {'.'.join(p['in'])}" if p["in"] else "")).select(F.col("tableName").alias("name"))
        df = df.where(~F.col("name").startswith("_brook_"))
        if session.relations and not p["in"]:
            df = df.union(spark.createDataFrame([(n,) for n in session.relations], "name string")).distinct()
    elif what in ("schemas", "databases"):
        df = spark.sql("show databases" + (f" in {'.'.join(p['in'])}" if p["in"] else "")).toDF("name")
    elif what == "catalogs":
        df = spark.sql("show catalogs").toDF("name")
    elif what == "functions":
        df = spark.sql("show functions").toDF("name")
        df = df.union(spark.createDataFrame([(n,) for n in session.functions], "name string")) if session.functions else df
    elif what.startswith("create "):
        df = spark.sql(f"show create table {'.'.join(p['in'])}").toDF("statement")
    else:
        raise QueryError(f"can't show {what}")
    return df.where(F.col(df.columns[0]).like(p["like"])) if p["like"] else df
