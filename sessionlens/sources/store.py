"""A client's store, a SQLite file, read in key ranges by many tasks, each in bounded pages.

The store is split at quantiles of its key (the change time, then the row), so that ranges hold about as many rows. A filter on
the change time, such as the high-water mark of the last read, is taken by the source: ranges below it are never made.
Reading needs ``spark.sql.python.filterPushdown.enabled``, else Spark filters what comes. The file must be on a path that
driver and executors share; it is opened for reading only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

FORMAT = "session_store"
#: Columns of the tables, with the row's own number first.
TABLES = {
    "part": "rowid long, id string, message_id string, session_id string, time_created long, time_updated long, data string",
    "message": "rowid long, id string, session_id string, time_created long, time_updated long, data string",
}
KEY = "time_updated"
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass
class KeyRange(InputPartition):
    """Rows whose change time is in [low, high]."""

    low: int
    high: int


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def held_columns(store: sqlite3.Connection, table: str) -> list[str]:
    """The table's columns in the store; a store of another version may lack some."""
    return [r[1] for r in store.execute(f'PRAGMA table_info("{table}")')]


class StoreReader(DataSourceReader):
    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.table = given["path"], given.get("table", "part")
        if self.table not in TABLES:
            raise ValueError(f"no table {self.table}")
        self.ranges, self.page = int(given.get("ranges", 8)), int(given.get("pagerows", 5000))
        self.columns = [c.split()[0] for c in TABLES[self.table].split(", ")]
        self.low, self.high = LEAST, MOST

    def pushFilters(self, filters) -> Iterator:
        """Bounds on the change time are taken; all others stay with Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != (KEY,) or not isinstance(value, int):
                yield f
            elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThanOrEqual | LessThan):
                self.high = min(self.high, value - isinstance(f, LessThan))
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, value), min(self.high, value)
            else:
                yield f

    def partitions(self) -> list[KeyRange]:
        """Ranges of about as many rows, by quantiles of the key inside the bounds; none if nothing lies there."""
        store = opened(self.path)
        try:
            bounds = (self.low, self.high)
            count = store.execute(f'SELECT count(*) FROM "{self.table}" WHERE {KEY} BETWEEN ? AND ?', bounds).fetchone()[0]
            if not count:
                return []
            at = sorted({count * k // self.ranges for k in range(1, self.ranges)} - {0})
            cuts = {store.execute(f'SELECT {KEY} FROM "{self.table}" WHERE {KEY} BETWEEN ? AND ? ORDER BY {KEY} LIMIT 1 OFFSET ?', (*bounds, n)).fetchone()[0] for n in at}
        finally:
            store.close()
        edges = [self.low, *sorted(c for c in cuts if self.low < c <= self.high)]
        return [KeyRange(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)] + [KeyRange(edges[-1], self.high)]

    def read(self, partition: KeyRange | None) -> Iterator[tuple]:
        """The range's rows in order of key, a page at a time: each page begins after the last key of the one before. Without ranges Spark asks for None."""
        if partition is None:
            return
        store = opened(self.path)
        try:
            held = set(held_columns(store, self.table)) | {"rowid"}
            chosen = ", ".join(c if c in held else f"NULL AS {c}" for c in self.columns)
            after = (partition.low, LEAST)
            time, row = self.columns.index(KEY), self.columns.index("rowid")
            while True:
                page = store.execute(f'SELECT {chosen} FROM "{self.table}" WHERE {KEY} <= ? AND ({KEY}, rowid) > (?, ?) ORDER BY {KEY}, rowid LIMIT ?', (partition.high, *after, self.page)).fetchall()
                yield from page
                if len(page) < self.page:
                    return
                after = (page[-1][time], page[-1][row])
        finally:
            store.close()


class StoreSource(DataSource):
    """``spark.read.format("session_store")``: options path, table (part or message), ranges and pageRows."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TABLES[{k.lower(): v for k, v in self.options.items()}.get("table", "part")]

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(dict(self.options))


def read_store(spark: SparkSession, path: str, table: str = "part", ranges: int = 8, page_rows: int = 5000, since: int | None = None) -> DataFrame:
    """Rows of a store's table, of those changed at ``since`` or later if it is given."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)
    df = spark.read.format(FORMAT).option("table", table).option("ranges", ranges).option("pageRows", page_rows).load(path)
    return df if since is None else df.where(df[KEY] >= since)
