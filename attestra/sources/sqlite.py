"""Tables of a SQLite database in a folder that driver and executors share (SRC16, SNK12), for ``sqlite:`` URLs.

``spark.read.format("sqlite_table")`` reads a partition for each predicate, each through a connection of its own; filters on
columns reach the database. ``df.write.format("sqlite_table")`` appends: a task is one transaction, the
database lets one in after another, and a task that fails leaves nothing.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Types of columns in the database, and what they are read as; ``INT`` is a 32-bit number, ``INTEGER`` may have 64.
STORED = {"bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "string": "TEXT", "boolean": "BOOLEAN"}
READ = {"BIGINT": "bigint", "INT": "int", "INTEGER": "bigint", "DOUBLE": "double", "REAL": "double", "TEXT": "string", "BOOLEAN": "boolean"}
WAIT_SECONDS = 3_600
ROWS = 10_000


def path_of(url: str) -> str:
    return url.removeprefix("sqlite:").removeprefix("file://")


def named(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def connected(path: str, write: bool = False) -> sqlite3.Connection:
    """Transactions are begun by hand; a lock that another task holds is waited for."""
    return sqlite3.connect(f"file:{quote(path)}?mode={'rwc' if write else 'ro'}", uri=True, timeout=WAIT_SECONDS, isolation_level=None)


def columns_of(path: str, table: str) -> list[tuple[str, str]]:
    """Names and types of a table's columns; none if there is no such table."""
    base = connected(path, write=True)
    try:
        found = base.execute("SELECT name, upper(type) FROM pragma_table_info(?)", (table,)).fetchall()
    finally:
        base.close()
    if odd := [f"{n} {k}" for n, k in found if k.split("(")[0].strip() not in (*READ, "VARCHAR")]:
        raise ValueError(f"{table}: columns of types that are not read: {', '.join(odd)}")
    return [(n, READ.get(k, "string")) for n, k in found]


@dataclass
class Rows(InputPartition):
    predicate: str

    def __init__(self, predicate: str):
        self.predicate = predicate


class TableReader(DataSourceReader):
    SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.names, self.kinds = options["path"], options["table"], schema.names, to_arrow_schema(schema)
        self.predicates = json.loads(options.get("predicates", "[]")) or ["1 = 1"]
        self.kept: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in self.SIGNS and len(f.attribute) == 1 and type(f.value) in (int, float, str):
                self.kept.append((f"{named(f.attribute[0])} {self.SIGNS[type(f)]} ?", f.value))
            else:
                yield f

    def partitions(self) -> list[Rows]:
        return [Rows(p) for p in self.predicates]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        tests = " AND ".join([f"({partition.predicate})", *(t for t, _ in self.kept)])
        base = connected(self.path)
        try:
            cursor = base.execute(f"SELECT {', '.join(map(named, self.names))} FROM {named(self.table)} WHERE {tests}", [v for _, v in self.kept])
            while rows := cursor.fetchmany(ROWS):
                columns = [[None if x is None else bool(x) for x in c] if pa.types.is_boolean(k.type) else c for c, k in zip(zip(*rows, strict=True), self.kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, self.kinds, strict=True)], names=self.names)
        finally:
            base.close()


class TableWriter(DataSourceArrowWriter):
    """Columns are matched by name; the table is made by the driver if it is not there."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path = options["path"]
        if odd := [f.name for f in schema if f.dataType.simpleString() not in STORED]:
            raise ValueError(f"columns of types that are not stored: {', '.join(odd)}")
        base = connected(self.path, write=True)
        try:
            base.execute(f"CREATE TABLE IF NOT EXISTS {named(options['table'])} ({', '.join(f'{named(f.name)} {STORED[f.dataType.simpleString()]}' for f in schema)})")
        finally:
            base.close()
        self.insert = f"INSERT INTO {named(options['table'])} ({', '.join(map(named, schema.names))}) VALUES ({', '.join('?' * len(schema))})"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        base = connected(self.path, write=True)
        try:
            for batch in iterator:
                for c in batch.columns:
                    if pa.types.is_floating(c.type) and pc.any(pc.is_nan(c)).as_py():
                        raise ValueError("SQLite has no NaN")
                if not base.in_transaction:
                    base.execute("BEGIN IMMEDIATE")
                base.executemany(self.insert, zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if base.in_transaction:
                base.execute("COMMIT")
        finally:
            base.close()  # an open transaction is rolled back
        return WriterCommitMessage()


class SqliteTable(DataSource):
    """Options: ``path``, ``table``, ``predicates`` (a JSON list of the database's SQL, one for each partition)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        found = columns_of(self.options["path"], self.options["table"])
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in found)

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        if overwrite:
            raise ValueError("a table is added to, not overwritten")
        return TableWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
