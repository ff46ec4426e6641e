"""Changes to tables: whole tables are written beside the old one and then take its name, so a failure leaves the old one."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lexer import QueryError


def replace_table(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df``, which may read the table, as the new content of table ``name``; partitioning and format of an old table stay."""
    spark = df.sparkSession
    writer = df.write.options(**(options or {}))
    if spark.catalog.tableExists(name):
        by = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
        if by and set(by) <= set(df.columns):
            writer = writer.partitionBy(*by)
    beside = f"{name}__new_{uuid.uuid4().hex[:12]}"
    writer.saveAsTable(beside)
    spark.sql(f"drop table if exists {name}")
    spark.sql(f"alter table {beside} rename to {name}")
    return spark.table(name)


def append(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rows of ``df`` by position into ``name``, or into its ``columns`` (defaults or nulls in the others); the table is made if there is none."""
    spark = df.sparkSession
    if columns and len(columns) != len(df.columns):
        raise QueryError(f"{len(df.columns)} columns can't be put into {len(columns)}")
    df = df.toDF(*columns) if columns else df
    if not spark.catalog.tableExists(name):
        df.write.saveAsTable(name)
        return spark.table(name)
    target = spark.table(name)
    if columns:
        view = f"_brook_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(view)
        try:
            spark.sql(f"insert into {name} ({', '.join(f'`{c}`' for c in columns)}) select * from {view}")
        finally:
            spark.catalog.dropTempView(view)
        return spark.table(name)
    if len(df.columns) != len(target.columns):
        raise QueryError(f"{name} has {len(target.columns)} columns, not {len(df.columns)}")
    df.write.insertInto(name)
    return spark.table(name)


def delete(spark: SparkSession, name: str, condition: str | None, alias: str | None = None) -> DataFrame:
    """Delete the rows for which ``condition`` is true: by the table's own means if it has any, else by writing the others anew."""
    if not spark.catalog.tableExists(name):
        raise QueryError(f"delete needs a table: {name}")
    try:
        spark.sql(f"delete from {name}{f' as {alias}' if alias else ''}{f' where {condition}' if condition else ''}")
        return spark.table(name)
    except (AnalysisException, PySparkException) as e:
        if "UNSUPPORTED" not in str(e).upper() and "NOT SUPPORT" not in str(e).upper():
            raise
    if condition is None:
        spark.sql(f"truncate table {name}")
        return spark.table(name)
    rows = spark.table(name).alias(alias or name.rsplit(".", 1)[-1])
    return replace_table(rows.where(f"not coalesce({condition}, false)"), name)


def update(spark: SparkSession, name: str, changes: list[tuple[str, str]], condition: str | None, alias: str | None = None) -> DataFrame:
    """Set columns to expressions over the old row where ``condition`` is true."""
    target = spark.table(name).alias(alias or name.rsplit(".", 1)[-1])
    new = {c.lower(): e for c, e in changes}
    unknown = set(new) - {c.lower() for c in target.columns}
    if unknown:
        raise QueryError(f"{name} has no column {', '.join(sorted(unknown))}")
    test = F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)
    cols = [F.when(test, F.expr(new[f.name.lower()]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in new else F.col(f"`{f.name}`") for f in target.schema]
    return replace_table(target.select(*cols), name)


def merge(spark: SparkSession, name: str, alias: str, source: DataFrame, source_alias: str, on: str, matched: list[tuple[str | None, dict[str, str] | None]], missing: list[tuple[str | None, dict[str, str]]]) -> DataFrame:
    """Rows of ``source`` into ``name``: the first fitting ``matched`` clause (condition, new values or None to delete) changes a
    row, the first fitting ``missing`` one (condition, values) puts a row in.  Two source rows for one row of the table are an error."""
    target = spark.table(name)
    t = target.alias(alias)
    s = source.withColumn("_there", F.lit(True)).alias(source_alias)
    both = t.join(s, F.expr(on), "left")
    if matched and both.count() != target.count():
        raise QueryError(f"several rows of the source match one row of {name}")
    there = F.coalesce(F.col(f"{source_alias}._there"), F.lit(False))

    def test(condition: str | None):
        return F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)

    which = F.lit(-1)
    for k, (condition, _) in reversed(list(enumerate(matched))):
        which = F.when(there & test(condition), F.lit(k)).otherwise(which)
    both = both.withColumn("_which", which)
    gone = [k for k, (_, new) in enumerate(matched) if new is None]
    if gone:
        both = both.where(~F.col("_which").isin(gone))
    cols = []
    for f in target.schema:
        value = F.col(f"{alias}.`{f.name}`")
        for k, (_, new) in enumerate(matched):
            expr = {c.lower(): e for c, e in (new or {}).items()}.get(f.name.lower())
            if expr is not None:
                value = F.when(F.col("_which") == k, F.expr(expr).cast(f.dataType)).otherwise(value)
        cols.append(value.alias(f.name))
    out = both.select(*cols)
    if missing:
        new = s.join(t, F.expr(on), "left_anti").alias(source_alias)
        which = F.lit(-1)
        for k, (condition, _) in reversed(list(enumerate(missing))):
            which = F.when(test(condition), F.lit(k)).otherwise(which)
        new = new.withColumn("_which", which).where("_which >= 0").alias(source_alias)
        cols = []
        for f in target.schema:
            value = F.lit(None).cast(f.dataType)
            for k, (_, values) in enumerate(missing):
                expr = {c.lower(): e for c, e in values.items()}.get(f.name.lower())
                if expr is not None:
                    value = F.when(F.col("_which") == k, F.expr(expr).cast(f.dataType)).otherwise(value)
            cols.append(value.alias(f.name))
        out = out.union(new.select(*cols))
    return replace_table(out, name)
