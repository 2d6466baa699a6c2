"""HOP: tumbling and hopping windows as a projection, without a range join.

Window ends lie on the slide's grid from the epoch (the same as a grid from midnight UTC when the slide divides a day). A row lies in a window if start <= time < end. A size below
the slide gives sampled windows. With bounds, only windows whose end lies in [first_end, last_end] are made, and the time range they can hold is filtered explicitly, which reaches the
scan. Columns window_start and window_end of the input are replaced. Rows with null time lie in no window.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DELAY = "spark.watermarkDelayMs"


def _seconds(span: dt.timedelta) -> str:
    return f"{span // dt.timedelta(microseconds=1)} microseconds"


def instant(at: dt.datetime, kind: str) -> Column:
    """A literal of the column's type; a naive time is UTC."""
    at = at if at.tzinfo is None else at.astimezone(dt.UTC).replace(tzinfo=None)
    ntz = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    return ntz if kind == "timestamp_ntz" else F.timestamp_micros(F.lit((at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)))


def hop(df: DataFrame, ts_col: str, size: dt.timedelta, slide: dt.timedelta | None = None, first_end: dt.datetime | None = None, last_end: dt.datetime | None = None) -> DataFrame:
    """The rows once per window that holds them, with window_start and window_end."""
    slide = slide or size
    kind = dict(df.dtypes)[ts_col]
    rows = df.drop("window_start", "window_end")
    time = F.col(f"`{ts_col}`")
    delay = df.schema[ts_col].metadata.get(_DELAY) if df.isStreaming else None  # the window's end carries the watermark on

    def end(column: Column) -> Column:
        return column.alias("window_end") if delay is None else column.alias("window_end", metadata={_DELAY: delay})

    if first_end is not None:
        rows = rows.where(time >= instant(first_end - size, kind))
    if last_end is not None:
        rows = rows.where(time < instant(last_end, kind))
    if size >= slide:
        offset = (-size) % slide
        window = F.window(time, _seconds(size), _seconds(slide), _seconds(offset))
        rows = rows.select("*", window.alias("_w")).select(*rows.columns, F.col("_w.start").alias("window_start"), end(F.col("_w.end")))
    else:
        grid = F.window(time, _seconds(slide))
        length = F.expr(f"make_dt_interval(0, 0, 0, {size / dt.timedelta(seconds=1):.6f})")
        rows = rows.select("*", grid.alias("_w")).select(*rows.columns, (F.col("_w.end") - length).alias("window_start"), end(F.col("_w.end")))
        rows = rows.where(time >= F.col("window_start"))
    if first_end is not None:
        rows = rows.where(F.col("window_end") >= instant(first_end, kind))
    if last_end is not None:
        rows = rows.where(F.col("window_end") <= instant(last_end, kind))
    return rows


def snap(at: dt.datetime, window: dt.timedelta) -> dt.datetime:
    """The last point of the window grid at or before the time."""
    base = dt.datetime(1970, 1, 1, tzinfo=at.tzinfo and dt.UTC)
    return at - (at - base) % window
