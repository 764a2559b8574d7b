"""SQLite tables as a Spark data source, in batches and as a stream of new rows.

A table is read by ranges of its key (the row id, or the first key column of a WITHOUT
ROWID table if that is a number); ranges that hold no row are skipped, so the number of
tasks follows the rows and not the span of their ids. Only the named columns are read.
Filters on the key are pushed whole: they narrow the ranges, and Spark does not evaluate
them again. Filters on other columns thin out what SQLite returns and stay in the plan,
since a column of SQLite can hold values of any type.

The file must be where all executors see it. Values that do not fit the declared type of
their column are null if it is a number, and text otherwise."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

from parley.operators.extract import Source

ROWS = 200_000  # ids a range spans, and 10,000 rows of them at once
MOST_RANGES = 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def connect(path: str) -> closing[sqlite3.Connection]:
    """A read-only connection that is closed at the end of the block."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return closing(db)


def _kind(declared: str) -> DataType:
    d = (declared or "").upper()
    if "INT" in d or "BOOL" in d:
        return LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return DoubleType()
    return BinaryType() if "BLOB" in d else StringType()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class Table:
    """Columns with their types, and what rows are dealt out by."""

    name: str
    schema: StructType
    #: SQL of the key, None if no number can divide the table.
    key: str | None
    #: The column that is the key, if a column is; its values are whole numbers and never null.
    key_column: str | None

    @staticmethod
    def of(db: sqlite3.Connection, name: str) -> Table:
        columns = db.execute(f"PRAGMA table_info({_quoted(name)})").fetchall()
        schema = StructType([StructField(c[1], _kind(c[2])) for c in columns])
        keys = sorted((c[5], c[1], (c[2] or "").upper()) for c in columns if c[5])
        taken = {c[1].lower() for c in columns}
        alias = next((a for a in ("_rowid_", "rowid", "oid") if a not in taken), None)
        try:
            db.execute(f"SELECT {alias} FROM {_quoted(name)} LIMIT 0")
        except sqlite3.OperationalError:
            alias = None  # WITHOUT ROWID
        if alias and len(keys) == 1 and keys[0][2] == "INTEGER" and "DESC" not in _sql_of(db, name):
            return Table(name, schema, _quoted(keys[0][1]), keys[0][1])
        if alias:
            return Table(name, schema, alias, None)
        first = keys[0][1] if keys and isinstance(_kind(keys[0][2]), LongType) else None
        if first and db.execute(f"SELECT 1 FROM {_quoted(name)} WHERE typeof({_quoted(first)}) <> 'integer' LIMIT 1").fetchone():
            first = None
        return Table(name, schema, _quoted(first) if first else None, first)


def _sql_of(db: sqlite3.Connection, name: str) -> str:
    row = db.execute("SELECT sql FROM sqlite_master WHERE type = 'table' AND name = ?", (name,)).fetchone()
    return (row[0] if row else "").upper()


class KeyRange(InputPartition):
    """Keys from ``low`` to ``high``, both included; all rows where there is no key."""

    def __init__(self, low: int = LEAST, high: int = MOST) -> None:
        self.low, self.high = low, high


def ranges(db: sqlite3.Connection, table: Table, low: int, high: int) -> list[KeyRange]:
    """Ranges of at most ROWS ids around the keys that exist, neighbours joined until there
    are at most MOST_RANGES. Each range costs one look into the index."""
    if table.key is None:
        return [KeyRange()]
    after = f"SELECT min({table.key}) FROM {_quoted(table.name)} WHERE {table.key} >= ? AND {table.key} <= ?"
    (last,) = db.execute(f"SELECT max({table.key}) FROM {_quoted(table.name)} WHERE {table.key} >= ? AND {table.key} <= ?", (low, high)).fetchone()
    out: list[tuple[int, int]] = []
    while last is not None and low <= last:
        (low,) = db.execute(after, (low, last)).fetchone()
        out.append((low, min(low + ROWS - 1, last)))
        low = out[-1][1] + 1
    step = -(-len(out) // MOST_RANGES) or 1
    return [KeyRange(out[k][0], out[min(k + step, len(out)) - 1][1]) for k in range(0, len(out), step)]


def _number(kind: type) -> Callable:
    def convert(v: object) -> float | int | None:
        try:
            return kind(v)
        except (TypeError, ValueError, OverflowError):
            return None

    return convert


CONVERT = {
    "bigint": (_number(int), pa.int64()),
    "double": (_number(float), pa.float64()),
    "string": (lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), pa.string()),
    "binary": (lambda v: v if isinstance(v, bytes) else str(v).encode(), pa.binary()),
}


def read_range(path: str, table: Table, names: Sequence[str], part: KeyRange, where: Sequence[str] = (), values: Sequence[object] = ()) -> Iterator[pa.RecordBatch]:
    kinds = [CONVERT[table.schema[n].dataType.simpleString()] for n in names]
    if table.key and (part.low, part.high) != (LEAST, MOST):
        where, values = [f"{table.key} >= ? AND {table.key} <= ?", *where], [part.low, part.high, *values]
    sql = f"SELECT {', '.join(map(_quoted, names))} FROM {_quoted(table.name)}" + (f" WHERE {' AND '.join(where)}" if where else "")
    with connect(path) as db:
        found = db.execute(sql, list(values))
        while rows := found.fetchmany(10_000):
            columns = [pa.array([None if v is None else convert(v) for v in c], kind) for c, (convert, kind) in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, list(names))


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: Table, names: Sequence[str]) -> None:
        self.path, self.table, self.names = path, table, names
        self.low, self.high = LEAST, MOST
        self.where: list[str] = []
        self.values: list[object] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the key narrow the ranges for good; of others SQLite drops what cannot
        match, and Spark looks again at the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column is None or column not in self.table.schema.names:
                yield f
            elif column == self.table.key_column and self._narrow(f):
                continue
            else:
                self._thin_out(column, f)
                yield f

    def _narrow(self, f: Filter) -> bool:
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, In) and f.value and all(map(whole, f.value)):
            self.where.append(f"{self.table.key} IN ({', '.join('?' * len(f.value))})")
            self.values += f.value
            self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
            return True
        if type(f) not in COMPARED or not whole(f.value):
            return False
        v = f.value
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, min(v + isinstance(f, GreaterThan), MOST))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.high = min(self.high, max(v - isinstance(f, LessThan), LEAST))
        # past the ends of a long no key is left
        if (isinstance(f, GreaterThan) and v == MOST) or (isinstance(f, LessThan) and v == LEAST):
            self.low, self.high = MOST, LEAST
        return True

    def _thin_out(self, column: str, f: Filter) -> None:
        q, kind = _quoted(column), self.table.schema[column].dataType
        if isinstance(f, IsNotNull):
            self.where.append(f"{q} IS NOT NULL")
        elif type(f) in COMPARED and isinstance(f.value, int | float) and not isinstance(f.value, bool) and isinstance(kind, LongType | DoubleType):
            self.where.append(f"({q} {COMPARED[type(f)]} ? OR typeof({q}) IN ('text', 'blob', 'real'))" if isinstance(kind, LongType) else f"({q} {COMPARED[type(f)]} ? OR typeof({q}) IN ('text', 'blob'))")
            self.values.append(f.value)
        elif isinstance(f, EqualTo) and isinstance(f.value, str) and isinstance(kind, StringType) and "�" not in f.value:
            self.where.append(f"({q} = ? OR typeof({q}) IN ('integer', 'real', 'blob'))")
            self.values.append(f.value)

    def partitions(self) -> Sequence[InputPartition]:
        if self.low > self.high:
            return []
        with connect(self.path) as db:
            return ranges(db, self.table, self.low, self.high)

    def read(self, partition: KeyRange | None) -> Iterator[pa.RecordBatch]:
        if partition:  # Spark makes one of None where there are none
            yield from read_range(self.path, self.table, self.names, partition, self.where, self.values)


class SqliteStreamReader(DataSourceStreamReader):
    """Rows by rising key: a batch holds the keys beyond the last offset. A row that changes
    after its key has passed is not read again."""

    def __init__(self, path: str, table: Table, names: Sequence[str], after: int) -> None:
        if table.key is None:
            raise ValueError(f"{table.name} has no numeric key to follow")
        self.path, self.table, self.names, self.after = path, table, names, after

    def initialOffset(self) -> dict:
        return {"key": self.after}

    def latestOffset(self) -> dict:
        with connect(self.path) as db:
            (last,) = db.execute(f"SELECT max({self.table.key}) FROM {_quoted(self.table.name)}").fetchone()
        return {"key": self.after if last is None else max(last, self.after)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start["key"] >= end["key"]:
            return []
        with connect(self.path) as db:
            return ranges(db, self.table, start["key"] + 1, end["key"])

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        return read_range(self.path, self.table, self.names, partition)


class SqliteTable(DataSource):
    """Options: ``path``, ``table``, ``columns`` (a JSON list, all if absent), and for a stream
    ``after``, the key it starts beyond."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _table(self) -> Table:
        with connect(self.options["path"]) as db:
            return Table.of(db, self.options["table"])

    def schema(self) -> StructType:
        table = self._table()
        want = json.loads(self.options.get("columns", "null"))
        return table.schema if want is None else StructType([f for f in table.schema if f.name in want])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self._table(), schema.names)

    def streamReader(self, schema: StructType) -> SqliteStreamReader:
        return SqliteStreamReader(self.options["path"], self._table(), schema.names, int(self.options.get("after", LEAST)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One table, or some columns of it; looks at the file anew whenever it is planned."""
    register(spark)
    reader = spark.read.format("sqlite_table").option("path", path).option("table", table)
    return (reader if columns is None else reader.option("columns", json.dumps(list(columns)))).load()


def follow(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None, after: int | None = None) -> DataFrame:
    """A stream of the rows of a table by rising key; Spark's checkpoint keeps the offsets."""
    register(spark)
    reader = spark.readStream.format("sqlite_table").option("path", path).option("table", table)
    reader = reader if after is None else reader.option("after", str(after))
    return (reader if columns is None else reader.option("columns", json.dumps(list(columns)))).load()


class _Tables(Mapping):
    """The tables of a file by name, each opened when it is asked for."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, list[str]]) -> None:
        self.spark, self.path, self.columns = spark, path, columns

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.columns:
            raise KeyError(name)
        return load(self.spark, self.path, name)

    def __contains__(self, name: object) -> bool:
        return name in self.columns

    def __iter__(self) -> Iterator[str]:
        return iter(self.columns)

    def __len__(self) -> int:
        return len(self.columns)


class SqliteSource(Source):
    """A file as a source for the extractors, which name the columns they need."""

    def _table(self, name: str, columns: Sequence[str]) -> DataFrame | None:
        if name not in self.tables:
            return None
        have = self.tables.columns[name]
        return load(self.spark, self.tables.path, name, [c for c in have if c in columns] or have[:1])


def read_source(spark: SparkSession, path: str, tables: Sequence[str] | None = None) -> SqliteSource:
    """All tables of a file (or those named) as a source for the extractors."""
    register(spark)
    with connect(path) as db:
        have = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'")]
        columns = {t: [c[1] for c in db.execute(f"PRAGMA table_info({_quoted(t)})")] for t in have if tables is None or t in tables}
    return SqliteSource(spark, _Tables(spark, path, columns))
