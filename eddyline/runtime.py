"""Running a pipeline over sources and sinks between two times."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from eddyline.plans.batch import emissions, evaluate
from eddyline.plans.pipeline import Pipeline
from eddyline.sources.memory import frame
from eddyline.streaming.runner import Runner


class Runtime:
    """execute(): batch by batch for sources with read() -> rows or a DataFrame. execute_bounded(): tables (DataFrames or sources with read(spark)) in one plan per output."""

    def __init__(self, spark: SparkSession, pipeline: Pipeline, sources: dict[str, Any], sinks: dict[str, Any]) -> None:
        self.spark, self.pipeline, self.sources, self.sinks = spark, pipeline, sources, sinks
        missing = set(pipeline.sources) - set(sources)
        if missing:
            raise ValueError(f"no source for {', '.join(sorted(missing))}")
        self.runner: Runner | None = None

    def execute(self, start: dt.datetime | None = None, end: dt.datetime | None = None) -> Runner:
        """Feeds one batch of each source in turn until all are exhausted or have reached the end."""
        notions = {n: s.time_notion for n, s in self.sources.items() if getattr(s, "time_notion", None)}
        self.runner = runner = Runner(self.spark, self.pipeline, self.sinks, notions, start, end)
        for name, source in self.sources.items():
            if start is not None and hasattr(source, "seek"):
                source.seek(start - self.pipeline.lookback(name))
            source.start()
        left = dict(self.sources)
        while left:
            for name, source in list(left.items()):
                rows = source.read()
                mark = runner.marks[name]
                if rows is None or runner.end and mark and mark >= runner.end:
                    source.stop()
                    del left[name]
                elif isinstance(rows, DataFrame):
                    runner.feed(name, rows)
                elif rows:
                    runner.feed(name, frame(self.spark, self.pipeline.sources[name].schema, rows))
        runner.finish()
        return runner

    def execute_bounded(self, start: dt.datetime | None = None, end: dt.datetime | None = None, close_all: bool = False) -> dict[str, DataFrame]:
        """Evaluates all outputs at once, writes them window by window and returns them."""
        tables = {}
        for name, source in self.sources.items():
            df = source if isinstance(source, DataFrame) else source.read(self.spark)
            tables[name] = df
        found = evaluate(self.spark, self.pipeline, tables, start, end, close_all=close_all)
        for name, df in found.items():
            if name in self.sinks:
                for part in emissions(df):
                    self.sinks[name].write(part)
        return found
