"""Running a pipeline batch by batch with its own watermarks: exact late-data semantics, window and record triggers, retention, ordered emission.

Each source's rows are retained as one parquet folder per batch under the work folder; a trigger that fires evaluates the same plan as a bounded run, over the retained rows and the
windows that are new. Folders whose rows no output needs any more are dropped. Progress is written after each batch, so a replayed batch is recognised and skipped.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.operators.hop import instant, snap
from eddyline.plans.batch import emissions
from eddyline.plans.pipeline import Pipeline
from eddyline.session import checkpoint_dir
from eddyline.time_notion import EventTimeNotion, ProcessingTimeNotion

_EPOCH = dt.datetime.fromtimestamp(0, dt.UTC)


def _utc(at: dt.datetime | None) -> dt.datetime | None:
    return at if at is None or at.tzinfo else at.replace(tzinfo=dt.UTC)


@dataclass
class _Progress:
    """What an output has done."""

    fired: dt.datetime | None = None
    seen: dt.datetime | None = None
    records: int = 0
    fires: int = 0


@dataclass
class _Kept:
    """A retained batch and its largest time."""

    path: str
    rows: int
    latest: dt.datetime | None = None


@dataclass
class Runner:
    """Feeds batches of the sources to a pipeline and writes to sinks (objects with write(df))."""

    spark: SparkSession
    pipeline: Pipeline
    sinks: dict[str, object]
    notions: dict[str, EventTimeNotion | ProcessingTimeNotion] = field(default_factory=dict)
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    work_dir: str | None = None

    def __post_init__(self) -> None:
        self.pipeline.compile()
        missing = set(self.pipeline.outputs) - set(self.sinks)
        if missing:
            raise ValueError(f"no sink for {', '.join(sorted(missing))}")
        self.start, self.end = _utc(self.start), _utc(self.end)
        self.work_dir = self.work_dir or f"{checkpoint_dir(self.spark)}/runner-{uuid.uuid4().hex}"
        for name, source in self.pipeline.sources.items():
            if source.ts_col and name not in self.notions:
                self.notions[name] = EventTimeNotion(source.ts_col)
        self.kept: dict[str, list[_Kept]] = {n: [] for n in self.pipeline.sources}
        self.marks: dict[str, dt.datetime | None] = dict.fromkeys(self.pipeline.sources)
        self.progress = {n: _Progress() for n in self.pipeline.outputs}
        self.batches: dict[str, int] = dict.fromkeys(self.pipeline.sources, -1)
        for name, out in self.pipeline.outputs.items():
            if out.policy.window and self.start:
                self.progress[name].fired = snap(self.start, out.policy.window) - out.policy.window
        self._restore()

    # -- progress

    def _state_path(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.work_dir}/progress.json")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _save(self) -> None:
        text = lambda t: t and t.isoformat()
        state = {
            "batches": self.batches,
            "marks": {k: text(v) for k, v in self.marks.items()},
            "kept": {k: [[b.path, b.rows, text(b.latest)] for b in v] for k, v in self.kept.items()},
            "progress": {k: [text(p.fired), text(p.seen), p.records, p.fires] for k, p in self.progress.items()},
        }
        path, fs = self._state_path()
        out = fs.create(path, True)
        out.write(json.dumps(state).encode())
        out.close()

    def _restore(self) -> None:
        path, fs = self._state_path()
        if not fs.exists(path):
            return
        stream = fs.open(path)
        state = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        stream.close()
        time = lambda s: s and dt.datetime.fromisoformat(s)
        self.batches |= state["batches"]
        self.marks |= {k: time(v) for k, v in state["marks"].items()}
        self.kept |= {k: [_Kept(p, n, time(t)) for p, n, t in v] for k, v in state["kept"].items()}
        self.progress |= {k: _Progress(time(f), time(s), r, n) for k, (f, s, r, n) in state["progress"].items()}

    # -- batches

    def feed(self, source: str, batch: DataFrame, batch_id: int | None = None) -> None:
        """One batch of a source. A batch id that was fed before is skipped."""
        batch_id = self.batches[source] + 1 if batch_id is None else batch_id
        if batch_id <= self.batches[source]:
            return
        declared = self.pipeline.sources[source]
        rows = declared.schema.conform(batch) if declared.schema else batch
        path = f"{self.work_dir}/{source}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        stored = self.spark.read.parquet(path)
        latest = F.max(F.unix_micros(F.col(declared.ts_col).cast("timestamp"))) if declared.ts_col else F.lit(None).cast("long")
        size, micros = stored.agg(F.count("*"), latest).first()
        self.batches[source] = batch_id
        if size:
            at = None if micros is None else _EPOCH + dt.timedelta(microseconds=micros)
            self.kept[source].append(_Kept(path, size, at))
            notion = self.notions.get(source)
            if isinstance(notion, ProcessingTimeNotion):
                at = notion.watermark(stored)
            elif at is not None and notion:
                at -= notion.allowed_lateness
            if at is not None and (self.marks[source] is None or at > self.marks[source]):
                self.marks[source] = at
            for name in self.pipeline.outputs:
                if source in self.pipeline.sources_of(name):
                    self._advance(name, size)
            self._expire()
        self._save()

    def finish(self) -> None:
        """After the last batch: outputs whose trigger is due fire once more."""
        for name in self.pipeline.outputs:
            self._fire_if_due(name)

    def tables(self, sources: list[str]) -> dict[str, DataFrame]:
        found = {}
        for name in sources:
            declared = self.pipeline.sources[name]
            paths = [k.path for k in self.kept[name]]
            if paths:
                found[name] = self.spark.read.parquet(*paths)
            elif declared.schema:
                found[name] = self.spark.createDataFrame([], declared.schema.to_struct_type())
            threshold = self.threshold(name)
            if name in found and threshold is not None:
                kind = dict(found[name].dtypes)[declared.ts_col]
                found[name] = found[name].where(F.col(declared.ts_col).isNull() | (F.col(declared.ts_col) >= instant(threshold, kind)))
        return found

    def retained(self, source: str) -> DataFrame | None:
        """The rows of a source that are still kept."""
        return self.tables([source]).get(source)

    # -- firing

    def watermark(self, output: str) -> dt.datetime | None:
        marks = [self.marks[s] for s in self.pipeline.sources_of(output)]
        return None if not marks or None in marks else min(marks)

    def _advance(self, output: str, rows: int) -> None:
        p, mark = self.progress[output], self.watermark(output)
        timed = any(self.pipeline.sources[s].ts_col for s in self.pipeline.sources_of(output))
        p.records += rows
        if not timed or mark is not None and (p.seen is None or mark > p.seen):
            p.seen = mark
            self._fire_if_due(output)

    def _target(self, output: str) -> dt.datetime | None:
        window, mark = self.pipeline.outputs[output].policy.window, self.watermark(output)
        if not window or mark is None:
            return None
        target = snap(mark, window)
        return min(target, snap(self.end, window)) if self.end else target

    def _fire_if_due(self, output: str) -> None:
        policy, p, target = self.pipeline.outputs[output].policy, self.progress[output], self._target(output)
        due_window = target is not None and (p.fired is None or target > p.fired)
        # windows only come from the watermark: over a view with HOP a number of records alone has none to emit
        due_records = policy.records is not None and p.records >= policy.records and not self.pipeline.hops(output)
        if not (due_window or due_records):
            return
        tables = self.tables(self.pipeline.sources_of(output))
        if due_window:
            result = self.pipeline.dataframe(self.spark, output, tables, end=target, after=p.fired)
            p.fired = target
        else:
            result = self.pipeline.dataframe(self.spark, output, tables)
        p.records, p.fires = 0, p.fires + 1
        for part in emissions(result):
            self.sinks[output].write(part)

    # -- retention

    def threshold(self, source: str) -> dt.datetime | None:
        """Rows older than this are not needed: the least over the outputs of what they fired minus their longest window. An output without a window keeps everything."""
        if not self.pipeline.sources[source].ts_col:
            return None
        lows = []
        for name, out in self.pipeline.outputs.items():
            if source in self.pipeline.sources_of(name):
                fired = self.progress[name].fired
                if not out.policy.window or fired is None or not self.progress[name].fires:
                    return None
                lows.append(fired - self.pipeline.longest_window(name))
        return min(lows, default=None)

    def _expire(self) -> None:
        for source, kept in self.kept.items():
            low = self.threshold(source)
            if low is not None:
                gone = [k for k in kept if k.latest is not None and k.latest < low]
                self.kept[source] = [k for k in kept if k not in gone]
                for k in gone:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(k.path)
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # -- structured streaming

    def attach(self, streams: dict[str, DataFrame], checkpoint: str, available_now: bool = True):
        """Starts one streaming query over all sources; each micro-batch feeds the sources in name order."""
        tagged = None
        for name in sorted(streams):
            one = streams[name].select(F.lit(name).alias("_source"), F.struct("*").alias(name))
            tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)

        def on_batch(df: DataFrame, batch_id: int) -> None:
            df.persist()
            for name in sorted(streams):
                self.feed(name, df.where(F.col("_source") == name).select(f"{name}.*"), batch_id)
            df.unpersist()

        writer = tagged.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
