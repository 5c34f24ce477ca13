"""A relational table as a Python data source: key ranges in parallel, filters at the source, and a stream with offsets.

``spark.read.format("keyed_table")`` reads a table of an SQLite file by ranges of an integer key; each task opens the file
itself, read-only, and sends rows in Arrow batches, so nothing passes through the driver but the key's smallest and largest
value. Filters given to ``read_table`` are part of every task's WHERE clause. (They are options, and not filters that Spark
pushes: Spark 4.1 keeps a Python reader with its relation, so filters pushed for one query would hold for the next one over
the same DataFrame.) ``readStream`` takes the same table as one that grows by ascending keys: the
offset is the largest key that was read, so a query that is started again goes on behind it.

The file has to be where all executors see it. A row whose key is null has no place in a range and is read by the last one.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME, BATCH = "keyed_table", 8192
_KINDS = {"INT": "long", "CHAR": "string", "TEXT": "string", "REAL": "double", "FLOA": "double", "DOUB": "double"}
SIGNS = ("=", "<>", "<", "<=", ">", ">=")


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path.removeprefix('file://'))}?mode=ro", uri=True)


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


@dataclass
class Range(InputPartition):
    """Keys from ``low`` (inclusive) to ``high`` (exclusive); None is open, and an open end takes null keys."""

    low: int | None
    high: int | None
    nulls: bool = False


def ranges(low: int, high: int, parts: int) -> list[Range]:
    """``parts`` ranges that cover low..high; the outer ones are open, so rows that came since are read too."""
    cuts = sorted({low + (high + 1 - low) * i // parts for i in range(1, parts)} - {low})
    return [Range(a, b, b is None) for a, b in zip([None, *cuts], [*cuts, None])]


class _Options:
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.key, self.schema = options["path"], options["table"], options["key"], schema
        self.parts = int(options.get("partitions", "8"))
        self.where = [tuple(w) for w in json.loads(options.get("where", "[]"))]
        if any(sign not in SIGNS or column not in schema.names for column, sign, _ in self.where):
            raise ValueError(f"filters are (column of the table, one of {' '.join(SIGNS)}, value)")

    def bounds(self) -> tuple[int, int] | None:
        db = _open(self.path)
        try:
            low, high = db.execute(f"SELECT min({_name(self.key)}), max({_name(self.key)}) FROM {_name(self.table)}").fetchone()
        finally:
            db.close()
        return None if low is None else (low, high)

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        key, clauses, values = _name(self.key), [f"{_name(c)} {sign} ?" for c, sign, _ in self.where], [v for *_, v in self.where]
        if part.low is not None:
            clauses, values = [*clauses, f"{key} >= ?"], [*values, part.low]
        if part.high is not None:
            clauses, values = [*clauses, f"{key} < ?"], [*values, part.high]
        elif part.nulls and part.low is not None:
            clauses[-1] = f"({key} >= ? OR {key} IS NULL)"
        schema = to_arrow_schema(self.schema)
        sql = f"SELECT {', '.join(map(_name, schema.names))} FROM {_name(self.table)}" + (" WHERE " + " AND ".join(clauses) if clauses else "")
        db = _open(self.path)
        try:
            found = db.execute(sql, values)
            while rows := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        finally:
            db.close()


class KeyedTable(DataSource):
    """Options: path of the file, table, key (an integer column), partitions (8), where (JSON list of filters)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        db = _open(self.options["path"])
        try:
            columns = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        finally:
            db.close()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        kind = lambda t: next((v for k, v in _KINDS.items() if k in t.upper()), "string")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(_Options(self.options, schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(_Options(self.options, schema))


class Reader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Range]:
        bounds = self.options.bounds()
        return [Range(None, None)] if bounds is None else ranges(*bounds, self.options.parts)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.options.rows(partition)


class StreamReader(DataSourceStreamReader):
    """A batch takes keys behind the last one's largest; rows must come with ascending keys, which have no nulls."""

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        bounds = self.options.bounds()
        return {"next": bounds[0] if bounds else 0}

    def latestOffset(self) -> dict:
        bounds = self.options.bounds()
        return {"next": bounds[1] + 1 if bounds else 0}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = start["next"], end["next"]
        if high <= low:
            return [Range(low, high)]
        cuts = sorted({low + (high - low) * i // self.options.parts for i in range(self.options.parts)} | {high})
        return [Range(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.options.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(KeyedTable)


def read_table(spark: SparkSession, path: str, table: str, key: str, partitions: int = 8, where: list[tuple[str, str, object]] = ()) -> DataFrame:
    """The table, or its rows for which every filter (column, sign, value) holds; a filter on a null column doesn't hold."""
    register(spark)
    return spark.read.format(NAME).options(path=path, table=table, key=key, partitions=partitions, where=json.dumps(list(where))).load()


def write_table(rows: DataFrame, path: str, table: str, key: str) -> None:
    """Adds rows to a table of the file, batch by batch as tasks end; for fixtures and exports, as a file has one writer."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL"}
    where = path.removeprefix("file://")
    os.makedirs(os.path.dirname(where) or ".", exist_ok=True)
    db = sqlite3.connect(where)
    try:
        db.execute(f"CREATE TABLE IF NOT EXISTS {_name(table)} ({', '.join(f'{_name(n)} {kinds.get(t, "TEXT")}' for n, t in rows.dtypes)})")
        db.execute(f"CREATE INDEX IF NOT EXISTS {_name(table + '_key')} ON {_name(table)} ({_name(key)})")
        marks = ", ".join("?" * len(rows.columns))
        for r in rows.toLocalIterator(prefetchPartitions=True):
            db.execute(f"INSERT INTO {_name(table)} VALUES ({marks})", tuple(r))
        db.commit()
    finally:
        db.close()
