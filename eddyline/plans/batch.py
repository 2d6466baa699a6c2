"""Bounded evaluation: all windows of a range in one plan per output."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.operators.hop import snap
from eddyline.plans.pipeline import Pipeline
from eddyline.session import checkpoint_dir
from eddyline.time_notion import EventTimeNotion


def final_watermark(pipeline: Pipeline, output: str, tables: Mapping[str, DataFrame], lateness: Mapping[str, dt.timedelta] | None = None) -> dt.datetime | None:
    """The least of the sources' watermarks; None while one has no time."""
    marks = []
    for name in pipeline.sources_of(output):
        ts_col = pipeline.sources[name].ts_col
        if ts_col is None:
            continue
        marks.append(EventTimeNotion(ts_col, (lateness or {}).get(name, dt.timedelta(0))).watermark(tables[name]))
    return None if not marks or None in marks else min(marks)


def evaluate(
    spark: SparkSession, pipeline: Pipeline, tables: dict[str, DataFrame], start: dt.datetime | None = None, end: dt.datetime | None = None, lateness: Mapping[str, dt.timedelta] | None = None, close_all: bool = False
) -> dict[str, DataFrame]:
    """A DataFrame per output. Windows end at or before the final watermark and the end; close_all also gives the windows that are still open."""
    found = {}
    for name, out in pipeline.outputs.items():
        stop = end
        if out.policy and out.policy.window and not close_all:
            mark = final_watermark(pipeline, name, tables, lateness)
            if mark is not None:
                stop = mark if end is None else min(mark, end)
        found[name] = pipeline.dataframe(spark, name, tables, start, stop)
    return found


def emissions(df: DataFrame) -> Iterator[DataFrame]:
    """The result per window_end in rising order, rows without one last, or as a whole if it has none; nothing for an empty result. The number of windows is that of the range, not of the data.

    The result is computed once, into a table in the shared folder with a partition per window, from which each window is read alone; it is removed when all windows have been taken, so
    a sink must have written when its write() returns. The order of a sorted result is kept."""
    spark, timed = df.sparkSession, "window_end" in df.columns
    path = f"{checkpoint_dir(spark)}/emission-{uuid.uuid4().hex}"
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    window = F.col("window_end").cast("string") if timed else F.lit("all")
    df.select(*named, F.monotonically_increasing_id().alias("position"), window.alias("window")).write.partitionBy("window").parquet(path)
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)]
    stored = spark.read.schema(T.StructType([*fields, T.StructField("position", T.LongType()), T.StructField("window", T.StringType())])).parquet(path)
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]
    is_sorted = df._jdf.queryExecution().analyzed().nodeName() == "Sort"
    try:
        end = F.col(f"c{df.columns.index('window_end')}") if timed else F.lit(None)
        for row in stored.select("window", end.alias("end")).distinct().orderBy(F.col("end").asc_nulls_last()).collect():
            part = stored.where(F.col("window").eqNullSafe(F.lit(row["window"])))
            yield (part.orderBy("position") if is_sorted else part).select(*back)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


__all__ = ["emissions", "evaluate", "final_watermark", "snap"]
