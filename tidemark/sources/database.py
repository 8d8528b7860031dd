"""Database tables as a Spark data source: partitioned scans with filters that the database evaluates, and idempotent inserts.

The database is SQLite (Python's own), in a file that all executors reach. A scan is parted by ranges of an integer key;
filters of Spark's plan (equality, membership, comparisons, NULL tests) become parameters of each range's
statement, and so do the columns that the plan asks for. Rows are fetched in batches by a cursor of each task.
A write inserts each task's rows in one transaction; rows whose key is stored are left alone, so that repeated tasks change nothing.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "tidemark_sqlite"
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_KINDS = {"string": "TEXT", "double": "REAL", "float": "REAL"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str, write: bool = False) -> sqlite3.Connection:
    """A connection that waits for other writers' transactions."""
    path = path.removeprefix("file://")
    return sqlite3.connect(path if write else f"file:{path}?mode=ro", uri=not write, timeout=120)


def condition(f: Filter) -> tuple[str, list] | None:
    """SQL and parameters of a filter, None if the database can't be trusted with it."""
    if len(f.attribute) != 1:
        return None
    name = quoted(f.attribute[0])
    if type(f) in _COMPARED and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
        return f"{name} {_COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, In) and f.value and len(f.value) <= 500 and all(isinstance(x, (int, float, str)) for x in f.value):
        return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
    return None


@dataclass
class Range(InputPartition):
    first: int | None  # None: rows without a key
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.o, self.schema, self.pushed = options, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            made = condition(f)
            if made is None:
                yield f
            else:
                self.pushed.append(made)

    def _where(self, more: list[str]) -> tuple[str, list]:
        parts = [sql for sql, _ in self.pushed] + more
        return (f" WHERE {' AND '.join(parts)}" if parts else ""), [x for _, values in self.pushed for x in values]

    def partitions(self) -> list[Range]:
        """Ranges of equal width over the keys that the filters leave."""
        key, n = quoted(self.o["key"]), int(self.o.get("partitions", 8))
        where, values = self._where([])
        with closing(connect(self.o["path"])) as db:
            low, high, none = db.execute(f"SELECT min({key}), max({key}), count(*) - count({key}) FROM {quoted(self.o['table'])}{where}", values).fetchone()
        found = [Range(None, 0)] if none else []
        if low is not None:
            step = max(1, -(-(high + 1 - low) // n))
            found += [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
        return found or [Range(0, 0)]

    def statement(self, part: Range) -> tuple[str, list]:
        key = quoted(self.o["key"])
        where, values = self._where([f"{key} IS NULL"] if part.first is None else [f"{key} >= ?", f"{key} < ?"])
        names = ", ".join(quoted(f.name) for f in self.schema)
        return f"SELECT {names} FROM {quoted(self.o['table'])}{where}", values + ([] if part.first is None else [part.first, part.end])

    def read(self, part: Range) -> Iterator[tuple]:
        sql, values = self.statement(part)
        with closing(connect(self.o["path"])) as db:
            cursor = db.execute(sql, values)
            while rows := cursor.fetchmany(int(self.o.get("fetch", 1000))):
                yield from rows


class Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.o, self.schema = options, schema

    def write(self, rows: Iterator) -> WriterCommitMessage:
        names = ", ".join(quoted(f.name) for f in self.schema)
        with closing(connect(self.o["path"], True)) as db, db:
            db.executemany(f"INSERT OR IGNORE INTO {quoted(self.o['table'])} ({names}) VALUES ({', '.join('?' * len(self.schema))})", (tuple(r) for r in rows))
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:  # what tasks inserted stays: the next run leaves it alone
        pass


class Database(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        raise ValueError("a database is read by a stated schema")

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema)


def create(path: str, table: str, schema: StructType, key: list[str]) -> None:
    """The table, if it isn't there."""
    columns = ", ".join(f"{quoted(f.name)} {_KINDS.get(f.dataType.simpleString(), 'INTEGER')}" for f in schema)
    with closing(connect(path, True)) as db, db:
        db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({columns}, PRIMARY KEY ({', '.join(map(quoted, key))}))")


def insert(df: DataFrame, path: str, table: str, key: list[str]) -> None:
    """df's rows whose key isn't in the table yet; the table is made if it isn't there."""
    df.sparkSession.dataSource.register(Database)
    create(path, table, df.schema, key)
    df.write.format(FORMAT).mode("append").options(path=path, table=table).save()


def scan(spark: SparkSession, path: str, table: str, schema: StructType, key: str = "ts", partitions: int = 8, fetch: int = 1000) -> DataFrame:
    """A table's rows by ranges of an integer key; filters on the result are evaluated by the database."""
    spark.dataSource.register(Database)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).schema(schema).options(path=path, table=table, key=key, partitions=str(partitions), fetch=str(fetch)).load()


def bars(spark: SparkSession, path: str, table: str, schema: StructType, symbol: str, timeframe: str | None = None, since: int | None = None, until: int | None = None, **options) -> DataFrame:
    """Bars of a stored candle table (symbol, timeframe, timestamp_ms and prices) of one symbol, within bounds (both included)."""
    rows = scan(spark, path, table, schema, "timestamp_ms", **options).filter(F.col("symbol") == symbol)
    for hold in (timeframe is not None and F.col("timeframe") == timeframe, since is not None and F.col("timestamp_ms") >= since, until is not None and F.col("timestamp_ms") <= until):
        rows = rows if hold is False else rows.filter(hold)
    return rows.select(F.col("symbol").alias("asset"), F.col("timestamp_ms").alias("ts"), "open", "high", "low", "close", "volume")


def replayed(spark: SparkSession, source: str, target: str, table: str, schema: StructType, key: list[str], by: str, scan_key: str = "ts") -> DataFrame:
    """Copies a table's rows to a second database (those that it has already stay) and returns the rows of each group in both, and whether they agree."""
    insert(scan(spark, source, table, schema, scan_key), target, table, key)
    counts = [scan(spark, p, table, schema, scan_key).groupBy(by).agg(F.count(F.lit(1)).alias(n)) for p, n in ((source, "n_source"), (target, "n_target"))]
    return counts[0].join(counts[1], by, "full").withColumn("equal", F.col("n_source").eqNullSafe(F.col("n_target")))
