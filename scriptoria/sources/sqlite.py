"""SQLite tables as a Python data source, format "sqlite": options path, table, partitions and equals."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def connect(path: str) -> closing:
    """A connection for reading, closed at the end of its block; the path may have any characters."""
    return closing(sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> T.DataType:
    """By SQLite's rules of affinity: whole numbers, texts, bytes and floating-point numbers; the rest is read as text."""
    d = (declared or "").upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.StringType()


class Rows(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    # No pushFilters: Spark keeps one reader for all uses of a loaded table, so filters of one query would hold in the next.
    def __init__(self, path: str, table: str, parts: int, equals: dict[str, int | str], schema: T.StructType):
        self.path, self.table, self.parts, self.schema = path, table, parts, schema
        self.where = [f"{quoted(c)} = ?" for c in equals]
        self.values = list(equals.values())

    def row_id(self) -> str | None:
        """A name of the row id that no column has; None if columns have all three, or for a table without."""
        with connect(self.path) as c:
            columns = {x[1].lower() for x in c.execute(f"PRAGMA table_info({quoted(self.table)})")}
            name = next((n for n in ("rowid", "oid", "_rowid_") if n not in columns), None)
            try:
                return name and c.execute(f"SELECT {name} FROM {quoted(self.table)} LIMIT 0") and name
            except sqlite3.OperationalError:
                return None

    def cast(self, column: str) -> str:
        """The column as its declared type, whatever a row holds."""
        kind = self.schema[column].dataType
        to = {T.LongType: "INTEGER", T.DoubleType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB"}.get(type(kind))
        if to is None:
            raise ValueError(f"{column}: {kind.simpleString()} can't be read from SQLite; use long, double, string or binary")
        return f"CAST({quoted(column)} AS {to})"

    def partitions(self) -> list[Rows]:
        name = self.row_id()
        if name is None:
            return [Rows(None, None)]
        with connect(self.path) as c:
            low, high = c.execute(f"SELECT min({name}), max({name}) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, -1)]
        step = -(-(high - low + 1) // max(1, self.parts))
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append(f"{self.row_id()} BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        sql = f"SELECT {', '.join(self.cast(f.name) for f in self.schema) or '1'} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with connect(self.path) as c:
            yield from c.execute(sql, values)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with connect(self.options["path"]) as c:
            columns = c.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(x[1], spark_type(x[2])) for x in columns])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], int(self.options.get("partitions", "8")), json.loads(self.options.get("equals", "{}")), schema)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: T.StructType | None = None, partitions: int = 8, equals: dict[str, int | str] | None = None) -> DataFrame:
    """A table, read by ranges of row ids; only rows whose columns have the values of ``equals``, compared in SQLite. Executors must see ``path``."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).option("equals", json.dumps(equals or {}))
    return (reader.schema(schema) if schema else reader).load()


def sqlite_tables(path: str) -> list[str]:
    with connect(path) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
