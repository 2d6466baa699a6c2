"""How far event time has come, given a batch."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventTimeNotion:
    """The largest time of the column minus the allowed lateness; nothing if all are null."""

    column: str
    allowed_lateness: dt.timedelta = dt.timedelta(0)

    def watermark(self, batch: DataFrame) -> dt.datetime | None:
        micros = F.unix_micros(F.max(F.col(self.column).cast("timestamp")))
        latest = batch.agg(micros.alias("t")).first()["t"]
        return None if latest is None else dt.datetime.fromtimestamp(0, dt.UTC) + dt.timedelta(microseconds=latest) - self.allowed_lateness

    def apply(self, stream: DataFrame) -> DataFrame:
        return stream.withWatermark(self.column, f"{int(self.allowed_lateness.total_seconds() * 1000)} milliseconds")


@dataclass(frozen=True)
class ProcessingTimeNotion:
    """The clock minus the allowed lateness."""

    allowed_lateness: dt.timedelta = dt.timedelta(0)
    column: str = "ingested_at"

    def watermark(self, batch: DataFrame) -> dt.datetime:
        return dt.datetime.now(dt.UTC) - self.allowed_lateness

    def apply(self, stream: DataFrame) -> DataFrame:
        return stream.withColumn(self.column, F.current_timestamp()).withWatermark(self.column, f"{int(self.allowed_lateness.total_seconds() * 1000)} milliseconds")
