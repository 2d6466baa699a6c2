"""Sources and sinks for tests, and user-defined sources."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from eddyline.operators.hop import instant
from eddyline.schema import Schema


@runtime_checkable
class BatchSource(Protocol):
    """What a user-defined input offers: batches of rows (a DataFrame or dicts) until it is exhausted (None); an empty list means that nothing has come yet."""

    def start(self) -> None: ...
    def read(self) -> DataFrame | list[dict[str, Any]] | None: ...
    def stop(self) -> None: ...


@runtime_checkable
class Replayable(Protocol):
    """An input that can start at an event time."""

    def seek(self, at: dt.datetime) -> None: ...


class FakeSource:
    """Gives prepared batches in order, with a pause of some seconds between them."""

    def __init__(self, batches: list[list[dict[str, Any]]], time_notion: Any = None, delay_between_batches: float = 0.0) -> None:
        self.batches, self.time_notion, self.delay, self.seek_timestamp, self._left = batches, time_notion, delay_between_batches, None, iter(())

    def start(self) -> None:
        self._left: Iterator[list[dict[str, Any]]] = iter(self.batches)

    def read(self) -> list[dict[str, Any]] | None:
        if self.delay:
            time.sleep(self.delay)
        return next(self._left, None)

    def seek(self, at: dt.datetime) -> None:
        self.seek_timestamp = at

    def stop(self) -> None:
        self._left = iter(())


class TableSource:
    """A table in batches, each a DataFrame: the rows whose batch column has the number of the batch (null counts as 0). seek() leaves out the rows before a time, those without one stay."""

    def __init__(self, table: DataFrame, batch: Column, n_batches: int, ts_col: str | None = None, time_notion: Any = None) -> None:
        self.table, self.batch, self.n_batches, self.ts_col, self.time_notion = table, batch, n_batches, ts_col, time_notion
        self.seek_timestamp: dt.datetime | None = None
        self._next = 0

    def start(self) -> None:
        self._next = 0

    def read(self) -> DataFrame | None:
        if self._next >= self.n_batches:
            return None
        rows = self.table.where(F.coalesce(self.batch.cast("long"), F.lit(0)) == self._next)
        if self.seek_timestamp is not None and self.ts_col:
            time = F.col(f"`{self.ts_col}`")
            rows = rows.where(time.isNull() | (time >= instant(self.seek_timestamp, dict(rows.dtypes)[self.ts_col])))
        self._next += 1
        return rows

    def seek(self, at: dt.datetime) -> None:
        self.seek_timestamp = at

    def stop(self) -> None:
        self._next = self.n_batches


class FakeSink:
    """Keeps what was written; a result for tests only, as rows come to the driver."""

    def __init__(self) -> None:
        self.batches: list[list[Row]] = []

    def write(self, df: DataFrame) -> None:
        self.batches.append(df.collect())

    def to_dicts(self) -> list[dict[str, Any]]:
        return [row.asDict(recursive=True) for batch in self.batches for row in batch]


def as_data_source(name: str, schema: type[Schema], factory: Any) -> type[DataSource]:
    """A Python data source class for readStream.format(name); factory() makes a BatchSource."""

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self) -> None:
            self.source = factory()
            self.source.start()
            self.held: dict[int, list[tuple]] = {}

        def initialOffset(self) -> dict:
            return {"batch": 0}

        def _rows(self, batch: list[dict[str, Any]]) -> list[tuple]:
            return [tuple(row.get(c) for c in schema.fields()) for row in batch]

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            batch = self.source.read()
            if not batch:
                return iter(()), start
            self.held[start["batch"]] = rows = self._rows(batch)
            return iter(rows), {"batch": start["batch"] + 1}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter([row for k in range(start["batch"], end["batch"]) for row in self.held.get(k, [])])

        def commit(self, end: dict) -> None:
            for k in [k for k in self.held if k < end["batch"]]:
                del self.held[k]

    class Made(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.to_struct_type())

        def simpleStreamReader(self, _: Any) -> Reader:
            return Reader()

    return Made


def frame(spark: SparkSession, schema: type[Schema], rows: list[dict[str, Any]]) -> DataFrame:
    """The rows as a DataFrame of the schema, missing fields null."""
    kinds = schema.to_struct_type()
    for f in kinds:
        f.nullable = True
    return spark.createDataFrame([tuple(r.get(f.name) for f in kinds) for r in rows], kinds)
