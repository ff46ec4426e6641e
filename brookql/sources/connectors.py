"""Connectors: other engines' tables as frames, and profiles that name them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.lexer import QueryError
from . import files

if TYPE_CHECKING:
    from ..session import Session


@dataclass
class Jdbc:
    """Tables behind a JDBC URL; a ``partitionColumn`` with bounds among the options reads a table in parallel."""

    url: str
    options: dict[str, str] = field(default_factory=dict)

    def reader(self, spark: SparkSession, name: str):
        return spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return self.reader(spark, name).load()


@dataclass
class Folder:
    """Files under a folder, named without their extension."""

    path: str
    extension: str = "parquet"

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return files.read(spark, f"{self.path.rstrip('/')}/{name.replace('.', '/')}.{self.extension}")


@dataclass
class SparkCatalog:
    """A catalog that the Spark session is configured with."""

    catalog: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.table(f"{self.catalog}.{name}")


@dataclass
class DuckDb:
    """Tables of a DuckDB file that all executors can reach, read in ranges of row numbers."""

    path: str
    partitions: int = 8

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        spark.dataSource.register(DuckDbSource)
        return spark.read.format("brook_duckdb").options(path=self.path, table=name, partitions=str(self.partitions)).load()


@dataclass
class Rows:
    """Tables made by Python functions, such as calls of a service: name -> (schema, function of (part, parts) to rows)."""

    tables: dict[str, tuple[str, Callable[[int, int], Iterator[tuple]]]]
    parts: int = 1

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.tables:
            raise QueryError(f"no such table: {name}")
        schema, make = self.tables[name]
        parts = self.parts

        class Source(RowsSource):
            row_schema, row_parts = schema, parts
            make_rows = staticmethod(make)

        spark.dataSource.register(Source)
        return spark.read.format("brook_rows").load()


class _Part(InputPartition):
    def __init__(self, k: int) -> None:
        super().__init__(k)
        self.k = k


class RowsSource(DataSource):
    row_schema, row_parts = "", 1
    make_rows: Any = None

    @classmethod
    def name(cls) -> str:
        return "brook_rows"

    def schema(self) -> str:
        return self.row_schema

    def reader(self, schema: T.StructType) -> DataSourceReader:
        make, parts = self.make_rows, self.row_parts

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [_Part(k) for k in range(parts)]

            def read(self, partition: _Part) -> Iterator[tuple]:
                yield from make(partition.k, parts)

        return Reader()


_DUCK_TYPES = {"BIGINT": "long", "INTEGER": "int", "SMALLINT": "short", "TINYINT": "byte", "HUGEINT": "decimal(38,0)", "VARCHAR": "string", "DOUBLE": "double", "FLOAT": "float", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "BLOB": "binary"}


class DuckDbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brook_duckdb"

    def _open(self):
        import duckdb

        return duckdb.connect(self.options["path"], read_only=True)

    def schema(self) -> str:
        with self._open() as con:
            columns = con.sql(f"describe {self.options['table']}").fetchall()
        return ", ".join(f"`{c[0]}` {_DUCK_TYPES.get(c[1], c[1].lower() if c[1].startswith('DECIMAL') else 'string')}" for c in columns)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        path, table, parts = self.options["path"], self.options["table"], int(self.options.get("partitions", 8))
        names = ", ".join(f'"{f.name}"' for f in schema)

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [_Part(k) for k in range(parts)]

            def read(self, partition: _Part):
                import duckdb

                with duckdb.connect(path, read_only=True) as con:
                    cursor = con.execute(f"select {names} from {table} where rowid % {parts} = {partition.k}")
                    while rows := cursor.fetchmany(10_000):
                        yield from rows

        return Reader()


_KINDS: dict[str, Callable[..., Any]] = {"jdbc": Jdbc, "files": Folder, "catalog": SparkCatalog, "duckdb": DuckDb}


def load_profile(session: Session, path: str, name: str | None = None) -> str:
    """Read a JSON profile: {"profiles": [{"name", "connectors": [{"name", "type", ...}], "settings": {...}}]}.

    ``${NAME}`` stands for a variable of the environment; one that is unset is an error.  Connectors are put into the session, and
    settings into Spark's.  The name of the profile is returned; without ``name`` the first is taken.
    """

    def filled(x: Any) -> Any:
        if isinstance(x, str):
            def value(m: re.Match[str]) -> str:
                if m[1] not in os.environ:
                    raise QueryError(f"the variable {m[1]} of the profile isn't set")
                return os.environ[m[1]]

            return re.sub(r"\$\{(\w+)\}", value, x)
        return {k: filled(v) for k, v in x.items()} if isinstance(x, dict) else [filled(v) for v in x] if isinstance(x, list) else x

    profiles = json.loads(files.text(session.spark, path))["profiles"]
    found = next((p for p in profiles if name is None or p["name"] == name), None)
    if found is None:
        raise QueryError(f"{path} has no profile {name}")
    found = filled(found)
    for c in found.get("connectors", []):
        c = dict(c)
        called, kind = c.pop("name"), c.pop("type")
        if kind not in _KINDS:
            raise QueryError(f"no such kind of connector: {kind}")
        session.connectors[called] = _KINDS[kind](**c)
    for k, v in found.get("settings", {}).items():
        session.spark.conf.set(k, v)
    return found["name"]
