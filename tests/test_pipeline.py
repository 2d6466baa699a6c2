"""Declarations, triggers, windows and retention against the documented rows."""

import datetime as dt

import pytest
from conftest import at

from eddyline import EventTimeNotion, Float, Int, Pipeline, Runtime, Schema, String, Timestamp
from eddyline.operators.hop import hop, snap
from eddyline.sources.memory import FakeSink, FakeSource, frame

M = lambda n: dt.timedelta(minutes=n)


class Event(Schema):
    id = Int()
    user_id = String()
    event_time = Timestamp()


class UserLocation(Schema):
    user_id = String()
    country = String()
    latitude = Float()
    longitude = Float()
    event_time = Timestamp()


class Order(Schema):
    order_id = String()
    product_id = String()
    quantity = Int()
    event_time = Timestamp()


class Product(Schema):
    product_id = String()
    category = String()
    price = Float()
    event_time = Timestamp()


class Game(Schema):
    name = String()
    team = String()
    score = Int()
    event_time = Timestamp()


def events(*rows):
    return [{"id": i, "user_id": u, "event_time": at(t)} for i, u, t in rows]


B1 = events((1, "alice", "10:01"), (2, "bob", "10:06"), (3, "alice", "10:11"), (4, "bob", "10:16"), (5, "alice", "10:21"))


@pytest.mark.parametrize(
    "first,last,size,slide,ids",
    [
        ("10:10", "10:10", 10, 10, [1, 2]),
        ("10:20", "10:20", 10, 10, [3, 4]),
        ("10:20", "10:20", 5, 10, [4]),
        ("10:10", "10:30", 10, 10, [1, 2, 3, 4, 5]),
    ],
)
def test_hop_members(spark, first, last, size, slide, ids):
    df = hop(frame(spark, Event, B1), "event_time", M(size), M(slide), at(first), at(last))
    assert sorted(r["id"] for r in df.collect()) == ids


def test_hop_end_is_exclusive_and_hopping_repeats(spark):
    df = frame(spark, Event, B1 + events((99, "x", "10:10")))
    assert 99 not in [r["id"] for r in hop(df, "event_time", M(10), M(10), at("10:10"), at("10:10")).collect()]
    starts = [r["s"] for r in hop(df, "event_time", M(10), M(5), at("10:10"), at("10:30")).where("id = 2").selectExpr("date_format(window_start, 'HH:mm') as s").orderBy("s").collect()]
    assert starts == ["10:00", "10:05"]


def test_hop_null_time_and_replaced_columns(spark):
    df = frame(spark, Event, [{"id": 1, "user_id": "a", "event_time": None}, *B1])
    once = hop(df, "event_time", M(10))
    assert once.count() == 5
    assert hop(once, "event_time", M(5)).columns == once.columns


def test_hop_reaches_the_scan(spark, tmp_path):
    frame(spark, Event, B1).write.parquet(str(tmp_path / "e"))
    df = hop(spark.read.parquet(str(tmp_path / "e")), "event_time", M(10), M(5), at("10:10"), at("10:20"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_time" in plan and "LessThan(event_time" in plan and "NestedLoop" not in plan


def test_snap():
    assert snap(at("10:07:31"), M(5)) == at("10:05")


def run(spark, sql, batches, start=None, end=None, window=None, records=None, views=(), schema=Event):
    app = Pipeline()
    app.source("events", schema=schema, ts_col="event_time")
    for name, text in views:
        app.view(name, text)
    app.output("out", sql).trigger(window=window, records=records)
    sink = FakeSink()
    source = FakeSource(batches, EventTimeNotion("event_time"))
    runner = Runtime(spark, app, {"events": source}, {"out": sink}).execute(start, end)
    return sink, runner, source


def test_records_trigger(spark):
    sink, _, _ = run(spark, "SELECT * FROM events", [events((1, "a", "10:00")), events((2, "b", "11:00"))], records=2)
    assert [len(b) for b in sink.batches] == [2]


def test_records_trigger_snapshots(spark):
    sink, _, _ = run(spark, "SELECT * FROM events", [events((1, "a", "10:00")), events((2, "b", "11:00"))], records=1)
    assert [len(b) for b in sink.batches] == [1, 2]


def test_filter_view(spark):
    batch = events((1, "alice", "10:00"), (2, "bob", "10:30"), (3, "alice", "11:00"))
    sink, _, _ = run(spark, "SELECT * FROM v", [batch], records=1, views=[("v", "SELECT * FROM events WHERE user_id = 'alice'")])
    assert len(sink.to_dicts()) == 2


COUNT = "SELECT COUNT(*) AS cnt, window_end FROM HOP('events', 'event_time', INTERVAL '10 minutes') GROUP BY window_end"


@pytest.mark.parametrize("split", [True, False])
def test_window_counts(spark, split):
    rows = events((1, "a", "10:05"), (2, "a", "10:15"), (3, "a", "10:25"), (4, "a", "10:35"))
    sink, _, _ = run(spark, COUNT, [[r] for r in rows] if split else [rows], at("10:00"), at("10:30"), window=M(10))
    assert [[r["cnt"] for r in b] for b in sink.batches] == [[1], [1], [1]]
    ends = [b[0]["window_end"] for b in sink.batches]
    assert ends == sorted(ends)


def test_rows_without_window_end_reach_the_sink(spark):
    sql = "SELECT COUNT(*) AS cnt, window_end FROM HOP('events', 'event_time', INTERVAL '10 minutes') GROUP BY ROLLUP(window_end)"
    rows = events((1, "a", "10:05"), (2, "a", "10:15"), (3, "a", "10:25"))
    sink, _, _ = run(spark, sql, [rows], at("10:00"), at("10:20"), window=M(10))
    assert [[(r["cnt"], r["window_end"] is None) for r in b] for b in sink.batches] == [[(1, False)], [(1, False)], [(2, True)]]
    app = Pipeline()
    app.source("events", schema=Event, ts_col="event_time")
    app.output("out", sql).trigger(window=M(10))
    app.output("late", "SELECT id, CASE WHEN id > 2 THEN event_time END AS window_end FROM events").trigger(records=1)
    sinks = {"out": FakeSink(), "late": FakeSink()}
    found = Runtime(spark, app, {"events": frame(spark, Event, rows)}, sinks).execute_bounded(at("10:00"), at("10:20"))
    assert {n: len(s.to_dicts()) for n, s in sinks.items()} == {n: df.count() for n, df in found.items()} == {"out": 3, "late": 3}
    assert [[r["id"] for r in sorted(b)] for b in sinks["late"].batches] == [[3], [1, 2]]


def test_late_row_is_not_counted_again(spark):
    rows = [events((1, "a", "10:05")), events((2, "a", "10:15")), events((3, "a", "10:02")), events((4, "a", "10:25")), events((5, "a", "10:35"))]
    sink, _, _ = run(spark, COUNT, rows, at("10:00"), at("10:30"), window=M(10))
    assert [b[0]["cnt"] for b in sink.batches] == [1, 1, 1]


def test_retention(spark):
    sql = "SELECT COUNT(*) AS cnt, window_end FROM HOP('events', 'event_time', INTERVAL '5 minutes') GROUP BY window_end"
    _, runner, _ = run(spark, sql, [events((1, "a", "10:00"), (2, "a", "10:01")), events((3, "a", "10:10"))], at("10:00"), at("11:00"), window=M(5))
    assert runner.retained("events").count() == 1


def test_lookback_seek(spark):
    sql = "SELECT COUNT(*) AS cnt, window_end FROM HOP('events', 'event_time', INTERVAL '15 minutes') GROUP BY window_end"
    _, _, source = run(spark, sql, [events((1, "a", "10:00"))], at("10:00"), at("10:15"), window=M(15))
    assert source.seek_timestamp == at("09:45")


def test_replayed_batch_is_skipped_and_state_is_restored(spark, tmp_path):
    from eddyline.streaming.runner import Runner

    app = Pipeline()
    app.source("events", schema=Event, ts_col="event_time")
    app.output("out", COUNT).trigger(window=M(10))
    sink = FakeSink()
    for _ in range(2):
        runner = Runner(spark, app, {"out": sink}, start=at("10:00"), work_dir=str(tmp_path / "w"))
        for k, row in enumerate([events((1, "a", "10:05")), events((2, "a", "10:15"))]):
            runner.feed("events", frame(spark, Event, row), k)
    assert [b[0]["cnt"] for b in sink.batches] == [1]


LOCATIONS = [
    ("alice", "US", 36.9, "10:00:01"), ("alice", "US", 37.1, "10:00:30"), ("bob", "US", 37.2, "10:00:45"), ("charlie", "UK", 51.5, "10:01:00"), ("david", "US", 37.3, "10:02:30"),
]


def test_latest_per_key_then_window(spark):
    rows = [{"user_id": u, "country": c, "latitude": lat, "longitude": 0.0, "event_time": at(t)} for u, c, lat, t in LOCATIONS]
    latest = """SELECT user_id, country, CAST(FLOOR(latitude) AS INTEGER) AS location_bucket, event_time FROM events
        QUALIFY ROW_NUMBER() OVER (PARTITION BY country, user_id ORDER BY event_time DESC) = 1"""
    sql = """SELECT window_start, window_end, country, location_bucket, COUNT(user_id) AS total_users
        FROM HOP('latest', 'event_time', INTERVAL '2 minutes') GROUP BY window_start, window_end, country, location_bucket"""
    sink, _, _ = run(spark, sql, [rows], at("10:00"), at("10:02"), window=M(1), views=[("latest", latest)], schema=UserLocation)
    got = [sorted((r["country"], r["location_bucket"], r["total_users"]) for r in b) for b in sink.batches]
    assert got == [[("US", 37, 2)], [("UK", 51, 1), ("US", 37, 2)]]


def shop():
    orders = [("o1", "p1", 2, "10:00:10"), ("o2", "p2", 1, "10:00:20"), ("o3", "p1", 3, "10:00:40"), ("o4", "p3", 1, "10:01:10"), ("o5", "p1", 1, "10:02:30")]
    products = [("p1", "electronics", 100.0, "10:00:05"), ("p2", "clothing", 50.0, "10:00:05"), ("p3", "electronics", 200.0, "10:00:05"), ("p4", "furniture", 300.0, "10:02:30")]
    app = Pipeline()
    app.source("orders", schema=Order, ts_col="event_time")
    app.source("products", schema=Product, ts_col="event_time")
    app.view("joined", """SELECT o.product_id, p.category, o.quantity * p.price AS revenue, o.window_end FROM HOP('orders', 'event_time', INTERVAL '1 minute') AS o
        JOIN HOP('products', 'event_time', INTERVAL '2 minutes') AS p ON o.product_id = p.product_id AND o.window_end = p.window_end""")
    app.output("revenue", "SELECT window_end, category, SUM(revenue) AS total_revenue, COUNT(*) AS order_count FROM joined GROUP BY window_end, category").trigger(window=M(1))
    data = {
        "orders": [{"order_id": a, "product_id": b, "quantity": c, "event_time": at(t)} for a, b, c, t in orders],
        "products": [{"product_id": a, "category": b, "price": c, "event_time": at(t)} for a, b, c, t in products],
    }
    return app, data


def totals(rows):
    out = {}
    for r in rows:
        a, b = out.get(r["category"], (0.0, 0))
        out[r["category"]] = a + r["total_revenue"], b + r["order_count"]
    return out


@pytest.mark.parametrize("bounded", [True, False])
def test_window_join_of_different_sizes(spark, bounded):
    app, data = shop()
    sink = FakeSink()
    if bounded:
        Runtime(spark, app, {"orders": frame(spark, Order, data["orders"]), "products": frame(spark, Product, data["products"])}, {"revenue": sink}).execute_bounded(at("10:00"), at("10:02"))
    else:
        sources = {k: FakeSource([v], EventTimeNotion("event_time")) for k, v in data.items()}
        Runtime(spark, app, sources, {"revenue": sink}).execute(at("10:00"), at("10:02"))
    assert totals(sink.to_dicts()) == {"electronics": (700.0, 3), "clothing": (50.0, 1)}


GAMES = [
    ("alice", 5, "12:00:23"), ("bob", 7, "12:02:26"), ("leo", 3, "12:03:30"), ("dave", 4, "12:04:17"), ("alice", 8, "12:03:05"), ("nick", 3, "12:06:38"),
    ("charlie", 9, "12:01:27"), ("eve", 8, "12:07:25"), ("nick", 1, "12:07:47"),
]


@pytest.mark.parametrize("start,end,ends", [("12:00", "12:10", {"12:02": 2, "12:04": 3, "12:06": 1}), ("12:02", "12:10", {"12:02": 2, "12:04": 3, "12:06": 1}), ("12:00", "12:06", {"12:02": 2, "12:04": 3, "12:06": 1})])
def test_team_windows(spark, start, end, ends):
    app = Pipeline()
    app.source("games", schema=Game, ts_col="event_time")
    app.output("out", "SELECT COUNT(*) AS cnt, window_end FROM HOP('games', 'event_time', INTERVAL '2 minutes') GROUP BY window_end").trigger(window=M(2))
    rows = frame(spark, Game, [{"name": n, "team": "red", "score": s, "event_time": at(t)} for n, s, t in GAMES])
    df = Runtime(spark, app, {"games": rows}, {}).execute_bounded(at(start), at(end))["out"]
    assert {r["e"]: r["cnt"] for r in df.selectExpr("date_format(window_end, 'HH:mm') as e", "cnt").collect()} == ends


def test_keyed_snapshot(spark):
    rows = [{"name": n, "team": "red", "score": s, "event_time": at(t)} for n, s, t in GAMES]
    app = Pipeline()
    app.source("games", schema=Game, ts_col="event_time", partition_by=["name"])
    app.output("out", "SELECT name, SUM(score) AS total FROM games GROUP BY name", partition_by=["name"]).trigger(records=1)
    sink = FakeSink()
    Runtime(spark, app, {"games": FakeSource([rows])}, {"out": sink}).execute()
    got = {r["name"]: r["total"] for r in sink.to_dicts()}
    assert (got["alice"], got["bob"], got["charlie"], got["nick"]) == (13, 7, 9, 4)


@pytest.mark.parametrize(
    "build,match",
    [
        (lambda a: a.output("o", COUNT).trigger(window=dt.timedelta(seconds=7)), "evenly"),
        (lambda a: a.output("o", COUNT).trigger(window=dt.timedelta(0)), "must be positive"),
        (lambda a: a.output("o", COUNT).trigger(records=5), "cannot be used with HOP"),
        (lambda a: (a.output("o", COUNT).trigger(window=M(3)), a.compile()), "must be a multiple"),
        (lambda a: (a.view("v", "SELECT user_id, COUNT(*) AS c FROM events GROUP BY user_id"), a.output("o", "SELECT * FROM v").trigger(records=1), a.compile()), "contains GROUP BY"),
        (lambda a: (a.output("o", "SELECT * FROM events"), a.compile()), "must have a trigger"),
        (lambda a: (a.view("v", "SELECT * FROM HOP('events', 'event_time', INTERVAL '5 minutes')"), a.output("o", "SELECT * FROM HOP('v', 'window_end', INTERVAL '5 minutes')").trigger(window=M(5)), a.compile()), "Stacked"),
        (lambda a: (a.view("v", "SELECT * FROM events"), a.view("v", "SELECT * FROM v"), a.output("o", "SELECT * FROM v").trigger(records=1), a.compile()), "depends on itself"),
        (lambda a: (a.view("v", "SELECT * FROM HOP('events', 'event_time', INTERVAL '5 minutes')"), a.output("o", "SELECT * FROM v").trigger(records=1), a.compile()), "needs a window trigger"),
    ],
)
def test_rejected(build, match):
    app = Pipeline()
    app.source("events", schema=Event, ts_col="event_time")
    with pytest.raises(ValueError, match=match):
        build(app)


def test_inferred_triggers_and_graph():
    app = Pipeline()
    app.source("events", schema=Event, ts_col="event_time")
    app.view("v", "SELECT * FROM events")
    app.output("a", "SELECT COUNT(*) AS c, window_end FROM HOP('v', 'event_time', INTERVAL '10 minutes') GROUP BY window_end").trigger(window=M(10))
    app.output("b", COUNT).trigger(window=M(5))
    nodes = app.compile()
    assert sorted(nodes["events"].downstream) == ["b", "v"] and nodes["a"].upstream == ["v"]
    assert nodes["events"].trigger.window == M(5) and nodes["v"].trigger.window == M(10) and nodes["v"].trigger.records == 1000
    assert app.lookback("events") == M(10)


def test_watermark_is_the_least_of_the_sources(spark):
    app = Pipeline()
    app.source("l", schema=Event, ts_col="event_time")
    app.source("r", schema=Event, ts_col="event_time")
    app.output("o", "SELECT l.id FROM l JOIN r ON l.id = r.id").trigger(records=1)
    runner = Runtime(spark, app, {"l": FakeSource([events((1, "a", "10:05"))]), "r": FakeSource([events((1, "a", "10:15"))])}, {"o": FakeSink()}).execute()
    assert runner.watermark("o") == at("10:05")


def test_watermark_query_waits_for_every_source(spark, tmp_path):
    from eddyline.queries.reference import watermark_min_of_sources

    first, last = dt.datetime(2024, 1, 1, 10, 5), dt.datetime(2024, 1, 1, 10, 15)
    rows = [("a", first), ("b", last), ("b", None), (None, last)]
    for k, (more, want) in enumerate([([], first), ([("c", None)], None)]):
        spark.createDataFrame(rows + more, "event_type string, ts timestamp_ntz").write.parquet(str(tmp_path / f"{k}/events.parquet"))
        assert [r["watermark"] for r in watermark_min_of_sources(spark, str(tmp_path / f"{k}")).collect()] == [want]
    spark.createDataFrame([], "event_type string, ts timestamp_ntz").write.parquet(str(tmp_path / "2/events.parquet"))
    assert watermark_min_of_sources(spark, str(tmp_path / "2")).first()["watermark"] is None


def test_streaming_matches_bounded(spark, tmp_path):
    from eddyline.sources.files import FileSource
    from eddyline.streaming import native
    from eddyline.streaming.runner import Runner

    rows = events(*[(i, "ab"[i % 2], f"10:{i * 3 % 60:02d}") for i in range(1, 18)], (99, "a", "11:30"))
    for k in range(0, len(rows), 6):
        frame(spark, Event, rows[k : k + 6]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    app = Pipeline()
    app.source("events", schema=Event, ts_col="event_time")
    app.output("out", "SELECT user_id, COUNT(*) AS cnt, window_end FROM HOP('events', 'event_time', INTERVAL '10 minutes') GROUP BY user_id, window_end").trigger(window=M(5))
    want = {(r["user_id"], r["cnt"], r["window_end"]) for r in app.dataframe(spark, "out", {"events": frame(spark, Event, rows)}, at("10:00"), at("11:30")).collect()}
    source = FileSource(str(tmp_path / "in"), schema=Event)
    sink = FakeSink()
    native.start(spark, app, "out", {"events": source.read_stream(spark, 1)}, sink, str(tmp_path / "c1")).awaitTermination()
    assert {(r["user_id"], r["cnt"], r["window_end"]) for b in sink.batches for r in b} == want
    sink = FakeSink()
    runner = Runner(spark, app, {"out": sink}, {"events": EventTimeNotion("event_time", dt.timedelta(0))}, at("10:00"), at("11:30"))
    runner.attach({"events": source.read_stream(spark, 100)}, str(tmp_path / "c2")).awaitTermination()
    assert {(r["user_id"], r["cnt"], r["window_end"]) for b in sink.batches for r in b} == want


def test_validated_output(spark):
    class Out(Schema):
        id = Int()
        user_id = String()

    app = Pipeline()
    app.source("events", ts_col="event_time")
    app.output("o", "SELECT id, user_id FROM events", schema=Out, validate=True).trigger(records=1)
    good = app.dataframe(spark, "o", {"events": frame(spark, Event, B1)})
    assert good.count() == 5
    bad = app.dataframe(spark, "o", {"events": frame(spark, Event, [{"id": None, "user_id": "a", "event_time": at("10:00")}])})
    with pytest.raises(Exception, match="null in column id"):
        bad.collect()


def test_window_or_records(spark):
    rows = [events((k, "a", t)) for k, t in enumerate(["10:01", "10:02", "10:06", "10:07", "10:08"], 1)]
    sink, _, _ = run(spark, "SELECT COUNT(*) AS n FROM events", rows, at("10:00"), window=M(5), records=2)
    assert [b[0]["n"] for b in sink.batches] == [1, 3, 5]


def test_file_and_fan_out_sinks(spark, tmp_path, capsys):
    from eddyline.sources.files import FileSink, FileSource
    from eddyline.sources.kafka import ConsoleSink, FanOutSink

    keep = FakeSink()
    FanOutSink([FileSink(str(tmp_path / "o"), partition_by=("user_id",)), ConsoleSink(), keep]).write(frame(spark, Event, B1))
    assert FileSource(str(tmp_path / "o"), schema=Event).read(spark).count() == 5 and len(keep.batches[0]) == 5
    assert len(capsys.readouterr().out.splitlines()) == 5


def test_missing_sink_or_source(spark):
    app = Pipeline()
    app.source("events", schema=Event, ts_col="event_time")
    app.output("o", "SELECT * FROM events").trigger(records=1)
    with pytest.raises(ValueError, match="no sink"):
        Runtime(spark, app, {"events": FakeSource([])}, {}).execute()
    with pytest.raises(ValueError, match="no source"):
        Runtime(spark, app, {}, {})


def test_broadcast_only_when_small(spark):
    from eddyline.operators import partitioning

    small = spark.range(10)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(partitioning.broadcast(small)) and "broadcast" not in plan(partitioning.broadcast(small, 10))


@pytest.mark.parametrize("mode", ["native", "runner"])
def test_window_join_on_streams(spark, tmp_path, mode):
    from eddyline.sources.files import FileSource
    from eddyline.streaming import native
    from eddyline.streaming.runner import Runner

    app, data = shop()
    streams = {}
    for name, schema in (("orders", Order), ("products", Product)):
        for k, row in enumerate(data[name]):
            frame(spark, schema, [row]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams[name] = FileSource(str(tmp_path / name), schema=schema).read_stream(spark, 1)
    sink = FakeSink()
    if mode == "native":
        native.start(spark, app, "revenue", streams, sink, str(tmp_path / "c")).awaitTermination()
    else:
        Runner(spark, app, {"revenue": sink}, start=at("10:00"), end=at("10:02")).attach(streams, str(tmp_path / "c")).awaitTermination()
    assert totals(sink.to_dicts()) == {"electronics": (700.0, 3), "clothing": (50.0, 1)}


def test_native_refuses_what_needs_the_runner():
    from eddyline.streaming import native

    app = Pipeline()
    app.source("events", schema=Event, ts_col="event_time")
    app.output("a", "SELECT * FROM events").trigger(records=1)
    app.output("b", f"{COUNT} ORDER BY window_end").trigger(window=M(10))
    app.output("c", COUNT).trigger(window=M(10))
    assert "record trigger" in native.unsupported(app, "a") and "sorts" in native.unsupported(app, "b") and native.unsupported(app, "c") is None


def test_records_do_not_fire_windows(spark):
    rows = [events((k, "a", t)) for k, t in enumerate(["10:01", "10:02", "10:06", "10:07", "10:12"], 1)]
    view = ("v", "SELECT * FROM HOP('events', 'event_time', INTERVAL '5 minutes')")
    sink, _, _ = run(spark, "SELECT COUNT(*) AS n, window_end FROM v GROUP BY window_end", rows, at("10:00"), window=M(5), records=2, views=[view])
    assert [(r["n"], r["window_end"].minute) for b in sink.batches for r in b] == [(2, 5), (2, 10)]


def test_casts_that_cannot_round_leave_the_others_alone(spark):
    app = Pipeline()
    app.source("events", schema=Event, ts_col="event_time")
    app.output("o", "SELECT (id > 2)::INTEGER AS late, (id + 0.7)::BIGINT AS up, CAST(id / 2 AS INTEGER) AS half FROM events").trigger(records=1)
    got = app.dataframe(spark, "o", {"events": frame(spark, Event, B1)}).collect()
    assert sorted(tuple(r) for r in got) == [(0, 2, 0), (0, 3, 1), (1, 4, 2), (1, 5, 2), (1, 6, 2)]


def test_native_keeps_the_declaration(spark, tmp_path):
    from eddyline.sources.files import FileSource
    from eddyline.streaming import native

    class Loose(Schema):
        id = Int(default=7)
        user_id = String(default="nobody")
        event_time = Timestamp()

    for k, (user, t) in enumerate([(None, "10:01"), ("a", "10:02"), ("a", "10:30")]):
        spark.createDataFrame([(str(k) if k else None, user, at(t))], "id string, user_id string, event_time timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    app = Pipeline()
    app.source("events", schema=Loose, ts_col="event_time")
    app.output("out", "SELECT user_id, SUM(id) AS ids, window_end FROM HOP('events', 'event_time', INTERVAL '10 minutes') GROUP BY user_id, window_end").trigger(window=M(10))
    sink = FakeSink()
    native.start(spark, app, "out", {"events": FileSource(str(tmp_path / "in")).read_stream(spark, 1)}, sink, str(tmp_path / "c")).awaitTermination()
    assert sorted((r["user_id"], r["ids"]) for b in sink.batches for r in b) == [("a", 1), ("nobody", 7)]
    assert app.sources["events"].schema is Loose


def test_emissions_keep_names_types_and_order(spark):
    from eddyline.plans.batch import emissions

    df = spark.sql("SELECT a AS `count(1)`, STRUCT(a, 'x') AS `s.t`, MAP('k', a) AS m, w AS window_end FROM VALUES (3, 2.5D), (1, 10D), (2, 2.5D), (9, NULL) AS t(a, w) ORDER BY a DESC")
    parts = [p.collect() for p in emissions(df)]
    assert [[r[0] for r in p] for p in parts] == [[3, 2], [1], [9]] and parts[0][0]["s.t"]["col2"] == "x" and parts[0][0]["m"] == {"k": 3}
    assert [p.columns for p in emissions(df)] == [df.columns] * 3
    assert [p.count() for p in emissions(spark.range(5))] == [5] and not list(emissions(df.limit(0)))


def test_windows_are_computed_once(spark, tmp_path):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def look(x: int) -> int:
        seen.add(1)
        return x

    app = Pipeline()
    app.source("events", schema=Event, ts_col="event_time")
    app.output("out", COUNT).trigger(window=M(10))
    rows = frame(spark, Event, B1).withColumn("id", F.udf(look, "int")("id")).where("id > 0")
    sink = FakeSink()
    Runtime(spark, app, {"events": rows}, {"out": sink}).execute_bounded(at("10:00"), at("10:20"))
    assert [b[0]["cnt"] for b in sink.batches] == [2, 2] and seen.value <= 2 * len(B1)


def test_sources_without_keys_are_broadcast(spark, tmp_path):
    frame(spark, Event, B1[:1]).write.parquet(str(tmp_path / "small"))
    app = Pipeline()
    app.source("events", schema=Event, ts_col="event_time", partition_by=["user_id"])
    app.source("small", schema=Event, ts_col="event_time", partition_by=[])
    app.output("o", "SELECT e.id FROM events e JOIN small s ON e.user_id = s.user_id").trigger(records=1)
    df = app.dataframe(spark, "o", {"events": frame(spark, Event, B1), "small": spark.read.parquet(str(tmp_path / "small"))})
    assert "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString() and "RepartitionByExpression" in df._jdf.queryExecution().analyzed().toString()
    assert sorted(r["id"] for r in df.collect()) == [1, 3, 5]
