"""Outputs as plain Structured Streaming queries, for plans of projections, HOP, window joins and window aggregates.

Late rows have the slack of one micro-batch that Structured Streaming gives; where that matters, or a plan needs row_number, sorting or record counts, use the runner.
"""

from __future__ import annotations

import copy
import dataclasses
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from eddyline.plans import sql as S
from eddyline.plans.pipeline import Pipeline


def unsupported(pipeline: Pipeline, output: str) -> str | None:
    """Why an output cannot run natively, or None."""
    out = pipeline.outputs[output]
    if out.policy is None or out.policy.window is None or out.policy.records is not None:
        return "it has a record trigger"
    for declared in [out, *(pipeline.views[v] for v in pipeline._upstream_views(out))]:
        words = {t.upper() for t in S.tokens(declared.sql)}
        if words & {"OVER", "QUALIFY", "ORDER", "LIMIT"}:
            return f"{declared.name} ranks or sorts rows"
    return None


def streaming_frame(spark: SparkSession, pipeline: Pipeline, output: str, streams: dict[str, DataFrame], lateness: dict[str, dt.timedelta] | None = None) -> DataFrame:
    """The output over streaming sources, with their watermarks."""
    if why := unsupported(pipeline, output):
        raise ValueError(f"{output} needs the runner: {why}")
    marked = {}
    for name in pipeline.sources_of(output):
        source = pipeline.sources[name]
        late = int((lateness or {}).get(name, dt.timedelta(0)).total_seconds() * 1000)
        rows = source.schema.conform(streams[name]) if source.schema else streams[name]
        marked[name] = rows.withWatermark(source.ts_col, f"{late} milliseconds") if source.ts_col else rows
    plan = copy.copy(pipeline)  # its rows conform already: a projection over the time column would lose its watermark
    plan.sources = {n: dataclasses.replace(s, schema=None) for n, s in pipeline.sources.items()}
    return plan.dataframe(spark, output, marked)


def first_copies(stream: DataFrame, keys: list[str], ts_col: str, within: dt.timedelta) -> DataFrame:
    """Of rows with the same keys the first that comes; copies whose times lie further apart than within may pass again, and keys are forgotten after it. Null keys are equal to each other."""
    return stream.withWatermark(ts_col, f"{int(within.total_seconds() * 1000)} milliseconds").dropDuplicatesWithinWatermark(keys)


def start(spark: SparkSession, pipeline: Pipeline, output: str, streams: dict[str, DataFrame], sink: object, checkpoint: str, lateness: dict[str, dt.timedelta] | None = None, available_now: bool = True):
    """Writes each micro-batch of the output to sink.write(df)."""
    frame = streaming_frame(spark, pipeline, output, streams, lateness)

    def on_batch(df: DataFrame, _: int) -> None:
        df.persist()
        if not df.isEmpty():
            sink.write(df)
        df.unpersist()

    writer = frame.writeStream.outputMode("append").foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
