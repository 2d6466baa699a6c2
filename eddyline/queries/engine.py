"""Queries of the parts around the SQL: declarations, sources and sinks, triggers, watermarks, retention, codecs and streams."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.functions import norm_id, tables
from eddyline.functions.columns import HOUR_US
from eddyline.operators.hop import instant
from eddyline.plans import sql as S
from eddyline.plans.pipeline import Pipeline
from eddyline.runtime import Runtime
from eddyline.schema import Float, Long, Schema, String, Timestamp
from eddyline.session import checkpoint_dir, cut_lineage
from eddyline.sources import codecs, kafka
from eddyline.sources.files import FileSink, FileSource
from eddyline.sources.memory import TableSource
from eddyline.streaming import native, stores
from eddyline.streaming.runner import Runner
from eddyline.time_notion import EventTimeNotion, ProcessingTimeNotion

HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)
START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)
_COUNT = "SELECT window_end, COUNT(*) AS cnt FROM HOP('events', 'ts', INTERVAL '1 day') GROUP BY window_end"


class Event(Schema):
    event_id = Long()
    ts = Timestamp(nullable=True)
    user_id = Long(nullable=True)
    event_type = String(nullable=True)
    value = Float(nullable=True)
    props = String(nullable=True)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "events")


def _as_table(df: DataFrame) -> DataFrame:
    """Columns of the events with the time as the table has it."""
    return df.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")


_DAYS = "datediff(ts, date'2024-01-01')"
_THIRD = f"coalesce(least({_DAYS} div 10, 2), 0)"  # batches in the order of time
_OLD_LAST = f"case when {_DAYS} >= 20 then 0 when {_DAYS} >= 10 then 1 else 2 end"  # the newest rows first
_SQL_DAYS = "date_diff('day', date '2024-01-01', ts::date)"


class _Gather:
    """A sink that keeps what is written, with the number of the write."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def write(self, df: DataFrame) -> None:
        self.parts.append(cut_lineage(df.withColumn("fire", F.lit(len(self.parts) + 1).cast("long"))))

    def all(self, spark: SparkSession, schema: str) -> DataFrame:
        whole = spark.createDataFrame([], schema)
        for part in self.parts:
            whole = whole.unionByName(part)
        return whole


# -- declarations


def _rejections() -> dict[str, tuple[Callable[[Pipeline], object], str]]:
    """Per rule, declarations that break it and what the error must say."""
    hop = "SELECT COUNT(*) AS c, window_end FROM HOP('events', 'ts', INTERVAL '10 minutes') GROUP BY window_end"
    minutes = lambda n: dt.timedelta(minutes=n)
    hopping = lambda a: a.view("v", "SELECT * FROM HOP('events', 'ts', INTERVAL '5 minutes')")
    return {
        "records trigger with HOP": (lambda a: a.output("o", hop).trigger(records=5), "cannot be used with HOP-based queries"),
        "window not positive": (lambda a: a.output("o", hop).trigger(window=dt.timedelta(0)), "Window must be positive"),
        "window does not divide a day": (lambda a: a.output("o", hop).trigger(window=dt.timedelta(seconds=7)), "evenly"),
        "no trigger": (lambda a: (a.output("o", "SELECT * FROM events"), a.compile()), "All outputs must have a trigger"),
        "size not a multiple of the window": (lambda a: (a.output("o", hop).trigger(window=minutes(3)), a.compile()), "must be a multiple of trigger window"),
        "GROUP BY in a view": (lambda a: (a.view("v", "SELECT user_id, COUNT(*) AS c FROM events GROUP BY user_id"), a.output("o", "SELECT * FROM v").trigger(records=1), a.compile()), "contains GROUP BY"),
        "stacked HOP": (lambda a: (hopping(a), a.output("o", "SELECT * FROM HOP('v', 'window_end', INTERVAL '5 minutes')").trigger(window=minutes(5)), a.compile()), "Stacked aggregations not supported"),
        "view of itself": (lambda a: (a.view("v", "SELECT * FROM events"), a.view("v", "SELECT * FROM v"), a.output("o", "SELECT * FROM v").trigger(records=1), a.compile()), "depends on itself"),
        "HOP in a view without window": (lambda a: (hopping(a), a.output("o", "SELECT * FROM v").trigger(records=1), a.compile()), "needs a window trigger"),
    }


def validation_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each rule on declarations and whether breaking it is refused with its message."""
    found = []
    for rule, (build, message) in _rejections().items():
        app = Pipeline()
        app.source("events", ts_col="ts")
        try:
            build(app)
            found.append((rule, False))
        except ValueError as e:
            found.append((rule, message in str(e)))
    app = Pipeline()
    app.source("events", ts_col="ts")
    app.output("o", "SELECT * FROM events").trigger(records=1)
    try:
        Runner(spark, app, {})
        found.append(("output without a sink", False))
    except ValueError as e:
        found.append(("output without a sink", "no sink" in str(e)))
    return spark.createDataFrame(found, "rule string, refused boolean")


def trigger_inference(spark: SparkSession, d: str) -> DataFrame:
    """The graph with inferred triggers, and how far before the start each source must be read."""
    app = Pipeline()
    app.source("events", ts_col="ts")
    app.view("paid", "SELECT * FROM events WHERE value > 0")
    app.view("hopped", "SELECT * FROM HOP('paid', 'ts', INTERVAL '2 hours')")
    app.output("by_hour", "SELECT window_end, COUNT(*) AS c FROM HOP('paid', 'ts', INTERVAL '1 hour') GROUP BY window_end").trigger(window=HOUR)
    app.output("by_half", "SELECT window_end, COUNT(*) AS c FROM hopped GROUP BY window_end").trigger(window=HOUR / 2)
    app.output("all_rows", "SELECT * FROM events").trigger(records=5)
    rows = []
    for name, node in app.compile().items():
        window = node.trigger.window and int(node.trigger.window.total_seconds())
        seen = int(app.lookback(name).total_seconds()) if node.kind == "source" else int(app.longest_window(name).total_seconds()) if node.kind == "output" else None
        rows.append((name, node.kind, window, node.trigger.records, ",".join(sorted(node.upstream)), ",".join(sorted(node.downstream)), seen))
    return spark.createDataFrame(rows, "name string, kind string, window_s int, records int, upstream string, downstream string, longest_s int")


def sql_questions(spark: SparkSession, d: str) -> DataFrame:
    """What is read from SQL texts: tables, HOP sources with time column and size, grouping."""
    texts = [
        "SELECT * FROM HOP('orders', 'o_orderdate', INTERVAL '1 day') JOIN customer ON true",
        "WITH a AS (SELECT * FROM lineitem) SELECT k, COUNT(*) FROM HOP(events, ts, INTERVAL 30 MINUTE) JOIN a ON true GROUP BY k",
        "SELECT 'GROUP BY' AS s FROM (SELECT * FROM part) AS p -- GROUP BY",
        "SELECT * FROM HOP('events', 'ts', INTERVAL '10 seconds') l JOIN HOP('events', 'ts', INTERVAL '2 hours') r ON l.window_end = r.window_end",
    ]
    rows = []
    for k, text in enumerate(texts):
        hops = ";".join(f"{t}.{c}={int(size.total_seconds())}" for t, (c, size) in sorted(S.hop_sources(text).items()))
        rows.append((k, ",".join(sorted(S.extract_tables(text))), hops, S.has_group_by(text)))
    return spark.createDataFrame(rows, "k int, tables string, hops string, grouped boolean")


# -- running over sources and sinks


def runtime_execute(spark: SparkSession, d: str) -> DataFrame:
    """A replayable source in batches, one of them empty, between two times: it is sought to the first window's start and stopped at the end; rows of the batch that passes the end count."""
    app, sink = Pipeline(), _Gather()
    app.source("events", ts_col="ts")
    app.output("out", _COUNT).trigger(window=DAY)
    batch = F.expr(f"case when {_DAYS} < 10 then 0 when {_DAYS} < 20 then 2 else 3 end")
    source = TableSource(_events(spark, d), batch, 5, "ts", EventTimeNotion("ts"))
    Runtime(spark, app, {"events": source}, {"out": sink}).execute(START, END)
    return sink.all(spark, "window_end timestamp_ntz, cnt long, fire long")


def lookback_scan(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a run from START reads: the source is sought to START minus the longest window of its outputs."""
    app, every = Pipeline(), _Gather()
    app.source("events", ts_col="ts")
    app.output("rows", "SELECT event_id, ts FROM events").trigger(records=1)
    app.output("windows", _COUNT.replace("1 day", "3 days")).trigger(window=DAY)
    source = TableSource(_events(spark, d), F.lit(0), 1, "ts", EventTimeNotion("ts"))
    Runtime(spark, app, {"events": source}, {"rows": every, "windows": _Gather()}).execute(START)
    return every.all(spark, "event_id long, ts timestamp_ntz, fire long").select("event_id", "ts")


def combined_trigger(spark: SparkSession, d: str) -> DataFrame:
    """A window of a day or 1 record, whichever comes first, over rows without HOP: a snapshot of the retained rows whenever the watermark advances; a window that fires ends the retention of
    the rows a day before it."""
    app, sink = Pipeline(), _Gather()
    app.source("events", ts_col="ts")
    app.output("out", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type").trigger(window=DAY, records=1)
    runner = Runner(spark, app, {"out": sink}, start=dt.datetime(2024, 1, 1))
    for k in range(3):
        runner.feed("events", _events(spark, d).where(f"{_THIRD} = {k}"))
    return sink.all(spark, "event_type string, n long, fire long")


def combined_trigger_hop_view(spark: SparkSession, d: str) -> DataFrame:
    """The same over a view with HOP: records alone open no window, each window comes out once."""
    app, sink = Pipeline(), _Gather()
    app.source("events", ts_col="ts")
    app.view("windowed", "SELECT * FROM HOP('events', 'ts', INTERVAL '1 day')")
    app.output("out", "SELECT window_end, COUNT(*) AS cnt FROM windowed GROUP BY window_end").trigger(window=DAY, records=1)
    runner = Runner(spark, app, {"out": sink}, start=dt.datetime(2024, 1, 1))
    for k in range(3):
        runner.feed("events", _events(spark, d).where(f"{_THIRD} = {k}"))
    return sink.all(spark, "window_end timestamp_ntz, cnt long, fire long").select("window_end", "cnt")


def monotone_watermark(spark: SparkSession, d: str) -> DataFrame:
    """The watermark of a source after each batch, the newest rows first: it never falls."""
    app = Pipeline()
    app.source("events", ts_col="ts")
    app.output("out", _COUNT).trigger(window=DAY)
    runner, rows = Runner(spark, app, {"out": _Gather()}), []
    for k in range(3):
        runner.feed("events", _events(spark, d).where(f"{_OLD_LAST} = {k}"))
        rows.append((k, runner.watermark("out")))
    return spark.createDataFrame([(k, at and at.replace(tzinfo=None)) for k, at in rows], "k long, watermark timestamp_ntz")


def allowed_lateness(spark: SparkSession, d: str) -> DataFrame:
    """Windows fire a day later with a lateness of a day, so rows of the next batch still count in windows that would have fired."""
    app, sink = Pipeline(), _Gather()
    app.source("events", ts_col="ts")
    app.output("out", _COUNT).trigger(window=DAY)
    runner = Runner(spark, app, {"out": sink}, {"events": EventTimeNotion("ts", DAY)})
    late = f"cast(coalesce(event_id % 4 = 0 and {_DAYS} % 10 = 9, false) as int)"  # a part of each batch's last day comes with the next one
    for k in range(3):
        runner.feed("events", _events(spark, d).where(f"least({_THIRD} + {late}, 2) = {k}"))
    return sink.all(spark, "window_end timestamp_ntz, cnt long, fire long").select("window_end", "cnt")


def min_watermark_windows(spark: SparkSession, d: str) -> DataFrame:
    """Two sources, one of which ends earlier: the windows of their union stop at the smaller watermark, also through a view."""
    app, sink = Pipeline(), _Gather()
    app.source("bought", ts_col="ts")
    app.source("other", ts_col="ts")
    app.view("both_kinds", "SELECT event_id, ts FROM bought UNION ALL SELECT event_id, ts FROM other")
    app.output("out", "SELECT window_end, COUNT(*) AS cnt FROM HOP('both_kinds', 'ts', INTERVAL '1 day') GROUP BY window_end").trigger(window=DAY)
    events = _events(spark, d)
    early = events.where(f"event_type = 'purchase' and {_DAYS} < 12")
    sources = {"bought": TableSource(early, F.lit(0), 1, "ts"), "other": TableSource(events.where("event_type <> 'purchase'"), F.lit(0), 1, "ts")}
    Runtime(spark, app, sources, {"out": sink}).execute()
    return sink.all(spark, "window_end timestamp_ntz, cnt long, fire long").select("window_end", "cnt")


def processing_time_windows(spark: SparkSession, d: str) -> DataFrame:
    """By the clock, which is far behind the events' times, all windows up to the end fire at the first batch."""
    app, sink = Pipeline(), _Gather()
    app.source("events", ts_col="ts")
    app.output("out", _COUNT).trigger(window=DAY)
    runner = Runner(spark, app, {"out": sink}, {"events": ProcessingTimeNotion(HOUR)}, end=dt.datetime(2024, 1, 25))
    runner.feed("events", _events(spark, d))
    return sink.all(spark, "window_end timestamp_ntz, cnt long, fire long")


def final_fire(spark: SparkSession, d: str) -> DataFrame:
    """Rows that come without advancing the watermark are counted by the last snapshot, after all sources have ended."""
    app, sink = Pipeline(), _Gather()
    app.source("events", ts_col="ts")
    app.output("out", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type").trigger(records=1)
    Runtime(spark, app, {"events": TableSource(_events(spark, d), F.expr(_OLD_LAST), 3, "ts")}, {"out": sink}).execute()
    return sink.all(spark, "event_type string, n long, fire long")


def bounded_emission(spark: SparkSession, d: str) -> DataFrame:
    """A bounded run writes its windows to the sink in order."""
    app, sink = Pipeline(), _Gather()
    app.source("events", ts_col="ts")
    app.output("out", _COUNT).trigger(window=DAY)
    Runtime(spark, app, {"events": _events(spark, d)}, {"out": sink}).execute_bounded()
    return sink.all(spark, "window_end timestamp_ntz, cnt long, fire long")


def fan_out_sinks(spark: SparkSession, d: str) -> DataFrame:
    """One emission to two folders, one of them partitioned and in JSON."""
    paths = [_folder(spark, "fan-out") for _ in range(2)]
    sinks = [FileSink(paths[0]), FileSink(paths[1], "json", ("event_type",))]
    kafka.FanOutSink(sinks).write(_events(spark, d).select("event_id", "event_type", "user_id"))
    first = FileSource(paths[0]).read(spark).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))
    kinds = "event_id long, user_id long, event_type string"
    second = spark.read.schema(kinds).json(paths[1]).groupBy("event_type").agg(F.count("*").alias("n_json"), F.sum("user_id").alias("users_json"))
    return first.join(second, "event_type")


def csv_and_json_files(spark: SparkSession, d: str) -> DataFrame:
    """The events written as CSV and as JSON lines and read by the declared schema."""
    found = []
    for kind in ("csv", "json"):
        path = _folder(spark, kind)
        options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
        _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).write.format(kind).options(**options).save(path)
        rows = FileSource(path, kind, Event, options).read(spark)
        found.append(_as_table(rows).withColumn("kind", F.lit(kind)))
    return found[0].unionByName(found[1])


# -- codecs and topics


def _topic(spark: SparkSession, d: str, spoiled: bool = False) -> kafka.KafkaSource:
    """The events as a recorded topic with JSON values keyed by user; spoiled: with as many values again that are no events."""
    sink = kafka.KafkaSink("events", "", key_serializer=codecs.JsonSerializer())
    rows = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    keyed = rows.withColumn(kafka.KEY, F.when(F.col("user_id").isNotNull(), F.struct("user_id")))
    encoded, path = sink.encode(keyed), _folder(spark, "topic")
    if spoiled:
        torn = encoded.select(F.expr("substring(value, 1, 20)").alias("value"), "key")
        encoded = encoded.unionByName(torn)
    kafka.record(encoded, "events", path, F.to_timestamp(F.get_json_object(F.col("value").cast("string"), "$.ts")))
    kafka.record(encoded.limit(0), "other", path, F.current_timestamp())

    class Key(Schema):
        user_id = Long()

    return kafka.KafkaSource("events", "", Event, key_deserializer=codecs.JsonDeserializer(Key), recorded=path)


def kafka_json_topic(spark: SparkSession, d: str) -> DataFrame:
    """Keyed JSON messages of a recorded topic, decoded; what cannot be decoded is dropped."""
    rows = _topic(spark, d, spoiled=True).read(spark)
    return rows.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props", F.col(kafka.KEY)["user_id"].alias("key_user"))


def kafka_seek(spark: SparkSession, d: str) -> DataFrame:
    """The same topic from a time on."""
    return _as_table(_topic(spark, d).seek(START).read(spark))


def kafka_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The topic as a stream through the runner to a recorded topic of results, read again."""
    app, out = Pipeline(), _folder(spark, "results")
    app.source("events", schema=Event, ts_col="ts")
    app.output("out", _COUNT).trigger(window=DAY)

    class Result(Schema):
        window_end = Timestamp()
        cnt = Long()

    class Sink:
        def write(self, df: DataFrame) -> None:
            kafka.record(kafka.KafkaSink("results", "").encode(df), "results", out, F.current_timestamp())

    kafka.record(spark.createDataFrame([], "value binary"), "results", out, F.current_timestamp())
    Runner(spark, app, {"out": Sink()}).attach({"events": _topic(spark, d).read_stream(spark).drop(kafka.KEY)}, _folder(spark, "offsets")).awaitTermination()
    found = kafka.KafkaSource("results", "", Result, recorded=out).read(spark)
    return found.select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "cnt")


def avro_topic(spark: SparkSession, d: str) -> DataFrame:
    """Events in Avro behind a registry header, and back."""
    registered: dict[str, str] = {}

    def register(topic: str, kind: str, schema: str) -> int:
        registered[kind] = schema
        return 7

    rows = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    encoded = kafka.KafkaSink("events", "", codecs.AvroSerializer(Event, register)).encode(rows)
    source = kafka.KafkaSource("events", "", Event, value_deserializer=codecs.AvroDeserializer(lambda topic, kind: registered[kind]))
    return _as_table(source.decode(encoded.withColumn("key", F.lit(None).cast("binary"))))


def custom_codec(spark: SparkSession, d: str) -> DataFrame:
    """Values encoded and decoded by functions of the user; those on which the function fails are dropped."""

    class Pair(Schema):
        event_id = Long()
        event_type = String()

    def write(row: dict, topic: str, is_key: bool = False) -> bytes:
        return f"{row['event_id']}|{row['event_type']}".encode()

    def read(raw: bytes, topic: str, is_key: bool = False) -> dict:
        number, kind = raw.decode().split("|")
        if kind == "error":
            raise ValueError(kind)
        return {"event_id": int(number), "event_type": kind}

    encoded = kafka.KafkaSink("pairs", "", codecs.CustomSerializer(write)).encode(_events(spark, d).select("event_id", "event_type"))
    return kafka.KafkaSource("pairs", "", Pair, value_deserializer=codecs.CustomDeserializer(read, Pair)).decode(encoded.withColumn("key", F.lit(None).cast("binary")))


# -- streams and user-defined functions


def native_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same output as a plain streaming query with a watermark, over files."""
    app, path = Pipeline(), _folder(spark, "native")
    app.source("events", schema=Event, ts_col="ts")
    app.output("out", _COUNT).trigger(window=DAY)
    spark.createDataFrame([], "window_end timestamp, cnt long").write.parquet(path)  # the sink appends
    stored = _folder(spark, "stream-input")
    _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(stored)
    stream = FileSource(stored, schema=Event).read_stream(spark, 1000)
    native.start(spark, app, "out", {"events": stream}, FileSink(path), _folder(spark, "offsets")).awaitTermination()
    return FileSource(path).read(spark).select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "cnt")


def native_stream_copies(spark: SparkSession, d: str) -> DataFrame:
    """A stream in which every event comes twice, the second time in another file: each passes once."""
    stored, path = _folder(spark, "stream-input"), _folder(spark, "native")
    rows = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        rows.write.mode("append").parquet(stored)
    spark.createDataFrame([], Event.to_struct_type()).write.parquet(path)  # the sink appends
    once = native.first_copies(FileSource(stored, schema=Event).read_stream(spark, 1000), ["event_id"], "ts", HOUR)
    query = once.writeStream.foreachBatch(lambda df, _: FileSink(path).write(df)).option("checkpointLocation", _folder(spark, "offsets"))
    query.trigger(availableNow=True).start().awaitTermination()
    return _as_table(FileSource(path, schema=Event).read(spark))


def user_functions(spark: SparkSession, d: str) -> DataFrame:
    """A function per row and an aggregate of the user in an output's SQL, both on Arrow batches."""

    @F.pandas_udf("double")
    def doubled(v: pd.Series) -> pd.Series:
        return v * 2

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    app = Pipeline()
    app.source("events", ts_col="ts")
    app.function("doubled", doubled)
    app.function("spread", spread)
    app.output("out", "SELECT user_id, SPREAD(twice) AS width FROM (SELECT user_id, DOUBLED(value) AS twice FROM events) GROUP BY user_id").trigger(records=1)
    return app.dataframe(spark, "out", {"events": _events(spark, d)})


def session_variables(spark: SparkSession, d: str) -> DataFrame:
    """A session variable in an output's SQL."""
    spark.sql("DECLARE OR REPLACE VARIABLE least_value DOUBLE DEFAULT 0.0")
    spark.sql("SET VAR least_value = 50.0")
    app = Pipeline()
    app.source("events", ts_col="ts")
    app.output("out", "SELECT event_type, COUNT(*) AS n FROM events WHERE value > session.least_value GROUP BY event_type").trigger(records=1)
    return app.dataframe(spark, "out", {"events": _events(spark, d)})


def _by_arrival(df: DataFrame, n: int) -> list[DataFrame]:
    """The messages in n micro-batches by even ranges of their offsets."""
    low, high = df.agg(F.min("msg_offset"), F.max("msg_offset")).first()
    if low is None:
        return [df, *[df.limit(0)] * (n - 1)]
    edges = [low - (-k * (high - low + 1) // n) for k in range(n + 1)]  # ranges reach the scan
    return [df.where(f"msg_offset >= {a} and msg_offset < {b}" + (" or msg_offset is null" if not k else "")) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def p2_store_replay(spark: SparkSession, d: str) -> DataFrame:
    """Order messages in four micro-batches through the store that lets each identifier pass once; rows without one all pass."""
    orders = tables(spark, d, "order_messages").select(norm_id("order_id").alias("id"), "msg_offset", F.unix_micros("arrival_time").alias("arrival_us"))
    store, kept = stores.RepeatStore(spark, _folder(spark, "repeats"), shards=16, compact_every=2), []
    for k, part in enumerate(_by_arrival(orders, 4)):
        kept.append(cut_lineage(store.feed(part, k).select("id", "msg_offset")))
    whole = kept[0]
    for part in kept[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("id").alias("order_id"), "msg_offset")


def p7_store_replay(spark: SparkSession, d: str) -> DataFrame:
    """Order messages in four micro-batches through the store of hourly multisets: what each hour holds after the last correction. A message is late by the watermark before its micro-batch."""
    orders = tables(spark, d, "order_messages").select("msg_offset", F.unix_micros("order_time").alias("us"), F.when(~F.isnan("amount"), F.col("amount")).alias("value"))
    store, parts = stores.PeriodStore(spark, _folder(spark, "periods"), compact_every=2), _by_arrival(orders, 4)
    for k, part in enumerate(parts):
        store.feed(part.drop("msg_offset"), k)
    return store.aggregates(len(parts) - 1).select(F.col("period_us").alias("hour_us"), "n_records", "n_values", "n_distinct", "smallest", "largest", "median")


QUERIES = {
    f.__name__: f
    for f in (
        validation_rules, trigger_inference, sql_questions, runtime_execute, lookback_scan, combined_trigger, combined_trigger_hop_view, monotone_watermark, allowed_lateness, min_watermark_windows,
        processing_time_windows, final_fire, bounded_emission, fan_out_sinks, csv_and_json_files, kafka_json_topic, kafka_seek, kafka_stream_windows, avro_topic, custom_codec, native_stream_windows, native_stream_copies,
        user_functions, session_variables, p2_store_replay, p7_store_replay,
    )
}

_DAILY = "select time_bucket(interval 1 day, ts) + interval 1 day as window_end, count(*) as cnt from events"
_FEED = f"select *, case when {_SQL_DAYS} >= 20 then 0 when {_SQL_DAYS} >= 10 then 1 else 2 end as batch from events"
_QUARTERS = """q as (select min(msg_offset) as low, max(msg_offset) as high from order_messages), o as (select *, (msg_offset - low) * 4 // (high - low + 1) as batch from order_messages, q)"""
ORACLES = {
    "validation_rules": "select unnest(['records trigger with HOP', 'window not positive', 'window does not divide a day', 'no trigger', 'size not a multiple of the window', 'GROUP BY in a view', 'stacked HOP', 'view of itself', 'HOP in a view without window', 'output without a sink']) as rule, true as refused",
    "trigger_inference": """select * from (values ('events', 'source', 1800, 1000, '', 'all_rows,paid', 7200), ('paid', 'view', 1800, 1000, 'events', 'by_hour,hopped', null), ('hopped', 'view', 1800, null, 'paid', 'by_half', null),
('by_hour', 'output', 3600, null, 'paid', '', 3600), ('by_half', 'output', 1800, null, 'hopped', '', 7200), ('all_rows', 'output', null, 5, 'events', '', 0)) t(name, kind, window_s, records, upstream, downstream, longest_s)""",
    "sql_questions": """select * from (values (0, 'customer,orders', 'orders.o_orderdate=86400', false), (1, 'a,events,lineitem', 'events.ts=1800', true), (2, 'part', '', false), (3, 'events', 'events.ts=7200', false)) t(k, tables, hops, grouped)""",
    "runtime_execute": f"{_DAILY} where ts >= timestamp '{START}' - interval 1 day group by 1 having window_end between timestamp '{START}' and timestamp '{END}'",
    "lookback_scan": f"select event_id, ts from events where ts >= timestamp '{START}' - interval 3 day or ts is null",
    "combined_trigger": f"""with b as (select *, coalesce(least({_SQL_DAYS} // 10, 2), 0) as batch from events), m as (select k, (select date_trunc('day', max(ts)) from b where batch < k) as fired from range(0, 3) r(k))
select event_type, count(*) as n, cast(k + 1 as bigint) as fire from b, m where batch <= k and coalesce(ts >= fired - interval 1 day, true) group by event_type, k""",
    "combined_trigger_hop_view": f"{_DAILY} group by 1 having window_end <= (select date_trunc('day', max(ts)) from events)",
    "monotone_watermark": "select k, (select max(ts) from events) as watermark from range(0, 3) r(k)",
    "allowed_lateness": f"""{_DAILY} group by 1 having window_end <= (select date_trunc('day', max(ts) - interval 1 day) from events)""",
    "min_watermark_windows": f"""with b as (select * from events where event_type = 'purchase' and {_SQL_DAYS} < 12), o as (select * from events where event_type <> 'purchase'),
m as (select date_trunc('day', least((select max(ts) from b), (select max(ts) from o))) as mark)
select time_bucket(interval 1 day, ts) + interval 1 day as window_end, count(*) as cnt from (select * from b union all select * from o) group by 1 having window_end <= (select mark from m)""",
    "processing_time_windows": f"{_DAILY} group by 1 having window_end <= timestamp '2024-01-25'",
    "final_fire": f"with b as ({_FEED}) select event_type, count(*) as n, k::bigint as fire from b join (values (1, 0), (2, 2)) f(k, upto) on batch <= upto group by event_type, k",
    "fan_out_sinks": "select event_type, count(*) as n, cast(sum(user_id) as bigint) as users, count(*) as n_json, cast(sum(user_id) as bigint) as users_json from events group by event_type",
    "csv_and_json_files": "select *, unnest(['csv', 'json']) as kind from events",
    "kafka_json_topic": "select *, user_id as key_user from events",
    "kafka_seek": f"select * from events where ts >= timestamp '{START}'",
    "kafka_stream_windows": f"{_DAILY} group by 1 having window_end <= (select date_trunc('day', max(ts)) from events)",
    "avro_topic": "select * from events",
    "custom_codec": "select event_id, event_type from events where event_type <> 'error'",
    "native_stream_windows": f"{_DAILY} group by 1 having window_end <= (select max(ts) from events)",
    "native_stream_copies": "select * from events",
    "user_functions": "select user_id, max(value * 2) - min(value * 2) as width from events group by user_id",
    "session_variables": "select event_type, count(*) as n from events where value > 50 group by event_type",
    "p2_store_replay": "select order_id, msg_offset from (select nullif(lower(trim(order_id)), '') as order_id, msg_offset, row_number() over (partition by nullif(lower(trim(order_id)), '') order by msg_offset) as rn from order_messages) where order_id is null or rn = 1",
    "p7_store_replay": f"""with {_QUARTERS}, b as (select batch, max(epoch_us(order_time)) as us from o group by 1), w as (select batch, max(us) over (order by batch rows between unbounded preceding and 1 preceding) - {6 * HOUR_US} as mark from b),
j as (select epoch_us(order_time) - epoch_us(order_time) % {HOUR_US} as hour_us, case when not isnan(amount) then amount end as v, mark from o join w using (batch) where order_time is not null)
select hour_us, count(*) as n_records, count(v) as n_values, count(distinct v) as n_distinct, min(v) as smallest, max(v) as largest, quantile_disc(v, 0.5) as median from j where coalesce(hour_us + {HOUR_US} > mark, true) group by 1""",
}
ORACLES["runtime_execute"] = f"select *, row_number() over (order by window_end) as fire from ({ORACLES['runtime_execute']})"
ORACLES["processing_time_windows"] = f"select *, row_number() over (order by window_end) as fire from ({ORACLES['processing_time_windows']})"
ORACLES["bounded_emission"] = f"select *, row_number() over (order by window_end) as fire from ({ORACLES['combined_trigger_hop_view']})"
