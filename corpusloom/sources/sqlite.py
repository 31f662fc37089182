"""Read-only SQLite tables as a Spark data source."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def connect(path: str) -> sqlite3.Connection:
    """A read-only connection that sees what the write-ahead log holds (hence never immutable)."""
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True, check_same_thread=False)


def spark_type(declared: str):
    """The Spark type of a declared column type, by SQLite's rules of affinity."""
    name = (declared or "").upper()
    if "INT" in name:
        return LongType()
    if "CHAR" in name or "CLOB" in name or "TEXT" in name:
        return StringType()
    if name == "BLOB":
        return BinaryType()
    if "REAL" in name or "FLOA" in name or "DOUB" in name or name == "TIMESTAMP":
        return DoubleType()
    return StringType()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.table, self.n = schema, options["path"], options["table"], int(options.get("partitions", "8"))

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids, which the table is stored by."""
        with connect(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, -1)]
        step = max(1, -(-(high - low + 1) // self.n))
        return [RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        names = ", ".join(_quoted(f.name) for f in self.schema)
        kinds = [f.dataType for f in self.schema]
        c = connect(self.path)
        try:
            for row in c.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)):
                yield tuple(_as(v, k) for v, k in zip(row, kinds))
        finally:
            c.close()


def _as(v, kind):
    """SQLite columns hold values of any type; what does not fit the declared one becomes it, or NULL."""
    if v is None:
        return None
    try:
        if isinstance(kind, LongType):
            return int(v)
        if isinstance(kind, DoubleType):
            return float(v)
        if isinstance(kind, BinaryType):
            return v if isinstance(v, bytes) else str(v).encode()
        return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
    except (TypeError, ValueError):
        return None


class SqliteDataSource(DataSource):
    """``spark.read.format("sqlite_ro").option("path", file).option("table", name).load()``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> StructType:
        with connect(self.options["path"]) as c:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return StructType([StructField(x[1], spark_type(x[2])) for x in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of a SQLite file; two files in one session take the place of ATTACH."""
    spark.dataSource.register(SqliteDataSource)
    return spark.read.format("sqlite_ro").option("path", path).option("table", table).option("partitions", str(partitions)).load()


def query(spark: SparkSession, sql: str, **values) -> DataFrame:
    """A query with bound values; they are parameters and never part of the text."""
    return spark.sql(sql, args=values)
