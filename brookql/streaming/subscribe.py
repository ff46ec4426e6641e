"""Subscriptions: a stream with a watermark, grouped by windows, and incremental loads of tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lexer import QueryError


def duration(text: str) -> str:
    """``1h``, ``30 minutes``: as Spark's windows say it."""
    units = {"ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days"}
    n = len(text) - len(text.lstrip("0123456789"))
    unit = text[n:].strip()
    if not n:
        raise QueryError(f"not a duration: {text}")
    return f"{text[:n]} {units.get(unit, unit)}"


def subscribed(df: DataFrame, watermark_column: str, window_size: str = "", slide: str = "", delay: str = "0s", gap: str = "") -> DataFrame:
    """``df`` with window_start and window_end: tumbling windows of ``window_size``, sliding ones every ``slide``, or sessions that
    a ``gap`` ends (grouped by :func:`subscribe` alone).  Of a stream, rows later than ``delay`` are dropped once windows are grouped."""
    if df.isStreaming:
        df = df.withWatermark(watermark_column, duration(delay))
    if gap or not window_size:
        return df
    w = F.window(watermark_column, duration(window_size), duration(slide) if slide else None)
    return df.withColumn("window", w).select("*", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")).drop("window") if not df.isStreaming else df.withColumn("window", w)


def subscribe(
    stream: DataFrame, watermark_column: str, window_size: str = "", delay: str = "0s", keys: tuple[str, ...] = (), aggregates: tuple[Column, ...] = (), slide: str = "", gap: str = "",
) -> DataFrame:
    """Rows of ``stream`` (or of a table) by window and ``keys``; a ``gap`` makes session windows.  Late rows as in :func:`subscribed`."""
    if stream.isStreaming:
        stream = stream.withWatermark(watermark_column, duration(delay))
    w = F.session_window(watermark_column, duration(gap)) if gap else F.window(watermark_column, duration(window_size), duration(slide) if slide else None)
    grouped = stream.groupBy(w.alias("window"), *keys)
    return grouped.agg(*(aggregates or (F.count(F.lit(1)).alias("n"),)))


def start(df: DataFrame, target: str, file: bool, options: dict[str, str]) -> Any:
    """Write what a stream has by now to a table or files, and wait: option checkpoint names the folder that remembers what was read."""
    options = dict(options)
    if "checkpoint" not in options:
        raise QueryError("a stream is saved with an option checkpoint")
    w = df.writeStream.trigger(availableNow=True).option("checkpointLocation", options.pop("checkpoint")).outputMode(options.pop("mode", "append")).options(**options)
    q = w.format("parquet").start(target) if file else w.toTable(target)
    q.awaitTermination()
    return q


def incremental(spark: SparkSession, source: str, target: str, checkpoint: str, change: Any = None, schema: Any = None) -> int:
    """Append to table ``target`` what came to the files under ``source`` since the last call, through ``change``; the rows of the target.

    ``change`` may select and filter only: an aggregate or join over the new rows alone would differ from one over all.
    """
    schema = schema if schema is not None else spark.read.parquet(source).schema
    df = spark.readStream.schema(schema).parquet(source)
    out = change(df) if change is not None else df
    plan = out._jdf.queryExecution().analyzed().toString()
    if any(x in plan for x in ("Aggregate ", "Join ", "Window ", "Distinct", "Sort ", "GlobalLimit")):
        raise QueryError("an incremental load takes filters and projections only")
    out.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode("append").toTable(target).awaitTermination()
    return spark.table(target).count()
