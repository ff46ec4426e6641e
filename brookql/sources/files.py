"""File sources and sinks by extension."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a query file that are read, at most.
MOST_TEXT = 16 << 20


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def text(spark: SparkSession, path: str) -> str:
    """A small text file from wherever Spark reads files."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1 or len(rows[0][0]) > MOST_TEXT:
        raise ValueError(f"{path} isn't one query file")
    return rows[0][0]


def fenced(text_: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of the fenced blocks of a Markdown file that are queries: tagged sql, flow or wv (or a language name beginning so)."""
    for kind, body in re.findall(r"^```(\w+)[^\n]*\n(.*?)^```", text_, re.S | re.M):
        if kind == "sql" or kind.startswith(("flow", "wv")):
            yield kind, body


def json_columns(sample: str) -> list[str]:
    """Names of a JSON object's members in the order they are written."""
    out, depth, at = [], 0, 0
    for m in re.finditer(r'"((?:[^"\\\\]|\\\\.)*)"(\s*:)?|[\[{]|[\]}]', sample[at:]):
        if m[0][0] in "[{":
            depth += m[0] == "{"
        elif m[0] in ("}", "]"):
            depth -= m[0] == "}"
            if not depth and out:
                break
        elif m[2] and depth == 1:
            out.append(m[1])
    return out


def _in_order(df: DataFrame, sample: str) -> DataFrame:
    first = [c for c in json_columns(sample) if c in df.columns]
    return df.select(*[f"`{c}`" for c in dict.fromkeys([*first, *df.columns])])


def json_text(spark: SparkSession, text_: str) -> DataFrame:
    """Rows of JSON given in a query: an array of objects, one object, or lines."""
    lines = spark.createDataFrame([(text_,)], "value string").rdd.map(lambda r: r[0])
    multi = text_.lstrip().startswith("[") or text_.strip().count("\n") == 0 or not all(x.strip().endswith("}") for x in text_.strip().splitlines())
    return _in_order(spark.read.json(lines) if multi else spark.read.json(spark.createDataFrame([(x,) for x in text_.strip().splitlines()], "value string").rdd.map(lambda r: r[0])), text_)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, ORC, JSON (lines or one array, in the files' column order) or CSV with a header; globs and remote paths as Spark takes them."""
    low = path.lower().removesuffix(".gz")
    if low.endswith((".json", ".jsonl", ".ndjson")):
        first = spark.read.text(path).limit(20).collect()
        sample = "\n".join(r[0] for r in first)[:100_000]
        multi = sample.lstrip().startswith("[") or bool(first) and first[0][0].strip() in ("{", "[")
        return _in_order(spark.read.option("multiLine", multi).json(path), sample)
    if low.endswith((".csv", ".tsv")):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if low.endswith(".tsv") else ",")
    if low.endswith(".orc"):
        return spark.read.orc(path)
    return spark.read.parquet(path)


def write(df: DataFrame, path: str, mode: str, options: dict[str, str]) -> None:
    """A folder of files, written by all tasks; with ``single: true`` one file, which one task writes.

    What is appended, or written over what is read, comes to stand beside the old files first.
    """
    low = path.lower()
    options = dict(options)
    single = str(options.pop("single", "false")).lower() == "true"
    kind = options.pop("format") if "format" in options else "text" if low.endswith(".txt") else "json" if low.endswith((".json", ".jsonl")) else "csv" if low.endswith((".csv", ".tsv")) else "orc" if low.endswith(".orc") else "parquet"
    if kind == "csv":
        options = {"header": "true", "sep": "\t" if low.endswith(".tsv") else ","} | options
    spark = df.sparkSession
    fs, target = _path(spark, path)
    if mode == "append" and not single and not (fs.exists(target) and fs.getFileStatus(target).isFile()):
        df.write.mode("append").options(**options).format(kind).save(path)
        return
    if mode == "append" and fs.exists(target):
        df, single = read(spark, path).union(df), True
    beside = f"{path.rstrip('/')}__new_{uuid.uuid4().hex[:12]}"
    (df.coalesce(1) if single else df).write.options(**options).format(kind).save(beside)
    _, made = _path(spark, beside)
    if fs.exists(target):
        fs.delete(target, True)
    if single:
        parts = [s.getPath() for s in fs.listStatus(made) if s.getPath().getName().startswith("part-")]
        fs.rename(parts[0], target)
        fs.delete(made, True)
    else:
        fs.rename(made, target)
