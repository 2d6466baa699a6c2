"""Queries of the pipeline language: windows, views, joins, triggers, and the SQL that outputs may use.

Each is an output of a pipeline over whole tables; the same text in DuckDB's dialect is the check.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.functions import tables
from eddyline.operators import partitioning
from eddyline.operators.hop import instant
from eddyline.plans.batch import final_watermark
from eddyline.plans.pipeline import Pipeline
from eddyline.session import cut_lineage
from eddyline.streaming.runner import Runner

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
_TS = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)
START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 10)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _pipeline(sql: str, window: dt.timedelta | None, views: dict[str, str], partition_by: list[str] | None = None) -> Pipeline:
    app = Pipeline()
    for name in TABLES:
        app.source(name, ts_col=_TS.get(name))
    for name, text in views.items():
        app.view(name, text)
    app.output("out", sql, partition_by=partition_by).trigger(window=window, records=None if window else 1)
    return app


def _add(name: str, sql: str, oracle: str | None = None, window: dt.timedelta | None = None, views: dict[str, str] | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None, partition_by: list[str] | None = None) -> None:
    """Registers an output under the name; the oracle is the same SQL unless given."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        app = _pipeline(sql, window, views or {}, partition_by)
        return app.dataframe(spark, "out", {t: tables(spark, d, t) for t in app.sources_of("out")}, start, end)

    QUERIES[name], ORACLES[name] = query, oracle or sql


def _windows(table: str, ts: str, size_h: float, slide_h: float) -> str:
    """All windows that hold each row, in DuckDB."""
    k = max(1, round(size_h / slide_h))
    slide, size = f"to_minutes({round(slide_h * 60)})", f"to_minutes({round(size_h * 60)})"
    ends = f"time_bucket({slide}, {ts}, timestamp '2000-01-01') + to_minutes((i * {round(slide_h * 60)})::int)"
    return f"(select x.*, {ends} - {size} as window_start, {ends} as window_end from {table} x, range(1, {k + 1}) r(i) where {ts} >= {ends} - {size})"


# -- windows

_add(
    "hop_tumbling_revenue",
    "SELECT event_type, ROUND(SUM(value), 2) AS total_value, COUNT(*) AS n, window_end FROM HOP('paid', 'ts', INTERVAL '1 hour') GROUP BY event_type, window_start, window_end",
    f"select event_type, round(sum(value), 2) as total_value, count(*) as n, window_end from {_windows('(select * from events where value > 0)', 'ts', 1, 1)} group by event_type, window_start, window_end",
    HOUR,
    {"paid": "SELECT event_id, event_type, value, ts FROM events WHERE value > 0"},
)
_add(
    "hop_hopping_count",
    "SELECT event_type, window_start, window_end, COUNT(*) AS n FROM HOP(events, ts, INTERVAL 6 HOUR) GROUP BY event_type, window_start, window_end",
    f"select event_type, window_start, window_end, count(*) as n from {_windows('events', 'ts', 6, 1)} group by all",
    HOUR,
)
_add("hop_rows_projection", "SELECT event_id, user_id, window_start, window_end FROM HOP('events', 'ts', INTERVAL '1 hour')", f"select event_id, user_id, window_start, window_end from {_windows('events', 'ts', 1, 1)}", HOUR)
_add(
    "hop_bounded_range",
    "SELECT event_type, window_end, COUNT(*) AS n FROM HOP('events', 'ts', INTERVAL '1 day') GROUP BY event_type, window_end",
    f"select event_type, window_end, count(*) as n from {_windows('events', 'ts', 24, 6)} where window_end between timestamp '{START}' and timestamp '{END}' group by all",
    6 * HOUR,
    start=START,
    end=END,
)
_add(
    "hop_sampled_window",
    "SELECT event_id, window_start, window_end FROM sampled",
    f"select event_id, window_start, window_end from {_windows('events', 'ts', 0.25, 1)}",
    HOUR,
    {"sampled": "SELECT * FROM HOP('events', 'ts', INTERVAL '15 minutes')"},
)
_add("hop_global_per_window", "SELECT window_end, COUNT(*) AS cnt FROM HOP('events', 'ts', INTERVAL '1 day') GROUP BY window_end", f"select window_end, count(*) as cnt from {_windows('events', 'ts', 24, 24)} group by all", DAY)
_add(
    "hop_avg_by_key",
    "SELECT user_id, window_end, ROUND(AVG(value), 4) AS mean_value FROM HOP('events', 'ts', INTERVAL '1 day') GROUP BY user_id, window_end ORDER BY window_end, user_id",
    f"select user_id, window_end, round(avg(value), 4) as mean_value from {_windows('events', 'ts', 24, 24)} group by all",
    DAY,
)
_add("view_filter_passthrough", "SELECT event_id, user_id, value FROM picked", "select event_id, user_id, value from events where event_type = 'purchase'", views={"picked": "SELECT * FROM events WHERE event_type = 'purchase'"})
_LATEST = "SELECT user_id, event_type, event_id, ts FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1"
_add(
    "view_latest_per_key_hop",
    "SELECT event_type, window_start, window_end, COUNT(user_id) AS total_users FROM HOP('latest', 'ts', INTERVAL '1 day') GROUP BY event_type, window_start, window_end",
    f"select event_type, window_start, window_end, count(user_id) as total_users from {_windows(f'({_LATEST})', 'ts', 24, 6)} group by all",
    6 * HOUR,
    {"latest": _LATEST},
)


def _joined(left_h: int, right_h: int) -> None:
    name = "window_join_same_size" if left_h == right_h else "window_join_diff_sizes"
    _add(
        name,
        "SELECT event_type, window_end, COUNT(*) AS n, ROUND(SUM(value), 2) AS total_value FROM joined GROUP BY event_type, window_end",
        f"""select r.event_type, l.window_end, count(*) as n, round(sum(l.value), 2) as total_value from {_windows("(select * from events where event_type = 'purchase')", 'ts', left_h, 6)} l
join {_windows("(select * from events where event_type <> 'purchase')", 'ts', right_h, 6)} r on l.user_id = r.user_id and l.window_end = r.window_end group by all""",
        6 * HOUR,
        {
            "bought": "SELECT user_id, value, ts FROM events WHERE event_type = 'purchase'",
            "other": "SELECT user_id, event_type, ts FROM events WHERE event_type != 'purchase'",
            "joined": f"SELECT r.event_type, l.value, l.window_end FROM HOP('bought', 'ts', INTERVAL '{left_h} hours') AS l JOIN HOP('other', 'ts', INTERVAL '{right_h} hours') AS r ON l.user_id = r.user_id AND l.window_end = r.window_end",
        },
    )


_joined(6, 6)
_joined(6, 12)
_add(
    "window_join_on_end_only",
    """SELECT l.window_end, l.n * r.n AS pairs FROM (SELECT window_end, COUNT(*) AS n FROM HOP('bought', 'ts', INTERVAL '5 minutes') GROUP BY window_end) l
JOIN (SELECT window_end, COUNT(*) AS n FROM HOP('other', 'ts', INTERVAL '5 minutes') GROUP BY window_end) r ON l.window_end = r.window_end""",
    f"""select l.window_end, count(*) as pairs from {_windows("(select * from events where event_type = 'purchase')", 'ts', 1 / 12, 1 / 12)} l
join {_windows("(select * from events where event_type <> 'purchase')", 'ts', 1 / 12, 1 / 12)} r on l.window_end = r.window_end group by all""",
    dt.timedelta(minutes=5),
    {"bought": "SELECT event_id, ts FROM events WHERE event_type = 'purchase'", "other": "SELECT event_id, ts FROM events WHERE event_type <> 'purchase'"},
)
_add(
    "join_then_agg_other_key",
    "SELECT c_mktsegment, window_end, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS total FROM HOP('known', 'o_orderdate', INTERVAL '7 days') GROUP BY c_mktsegment, window_end",
    f"select c_mktsegment, window_end, count(*) as n_orders, round(sum(o_totalprice), 2) as total from {_windows('(select o.*, c_mktsegment from orders o join customer on o_custkey = c_custkey)', 'o_orderdate', 168, 24)} group by all",
    DAY,
    {"known": "SELECT o.o_orderkey, o.o_totalprice, o.o_orderdate, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"},
)
_add(
    "elapsed_minutes",
    "SELECT o_orderkey, l_linenumber, EXTRACT(EPOCH FROM (l_shipdate - o_orderdate)) / 60.0 AS minutes, FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "select o_orderkey, l_linenumber, extract(epoch from (l_shipdate - o_orderdate)) / 60.0 as minutes from orders join lineitem on o_orderkey = l_orderkey",
)
_add(
    "nested_hop",
    "SELECT event_type, window_end, COUNT(*) AS n FROM HOP('inner_windows', 'ts', INTERVAL '3 hours') GROUP BY event_type, window_end",
    f"select event_type, window_end, count(*) as n from {_windows(f'(select event_id, event_type, ts from {_windows("events", "ts", 2, 1)})', 'ts', 3, 1)} group by all",
    HOUR,
    {"inner_windows": "SELECT * FROM HOP('events', 'ts', INTERVAL '2 hours')"},
)
_add("agg_by_key_snapshot", "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total_value, CAST(SUM(user_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
_add("repartition_agg", "SELECT user_id, COUNT(*) AS n, MAX(value) AS largest FROM events GROUP BY user_id", partition_by=["user_id"])


# -- triggers, watermarks and retention, through the runner

_BATCHES = 3  # every row is in one of them


class _Keep:
    """Keeps the results of an output as DataFrames, with the number of the write."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def write(self, df: DataFrame) -> None:
        self.parts.append(cut_lineage(df.withColumn("fire", F.lit(len(self.parts) + 1).cast("long"))))

    def all(self, spark: SparkSession, schema: str) -> DataFrame:
        """All of them; nothing was written for an empty table."""
        whole = spark.createDataFrame([], f"{schema}, fire long")
        for part in self.parts:
            whole = whole.unionByName(part)
        return whole


def _replay(spark: SparkSession, d: str, app: Pipeline, batch: F.Column, start: dt.datetime | None = None) -> tuple[Runner, _Keep]:
    """Feeds the events to the pipeline in batches."""
    keep = _Keep()
    runner = Runner(spark, app, {"out": keep}, start=start)
    events = tables(spark, d, "events").withColumn("_batch", batch)
    for k in range(_BATCHES):
        runner.feed("events", events.where(F.col("_batch") == k).drop("_batch"))
    return runner, keep


def _events_only(sql: str, window: dt.timedelta | None = None) -> Pipeline:
    app = Pipeline()
    app.source("events", ts_col="ts")
    app.output("out", sql).trigger(window=window, records=None if window else 1)
    return app


def late_drop_replay(spark: SparkSession, d: str) -> DataFrame:
    """Batches that overlap in time: rows of windows that have fired are left out."""
    app = _events_only("SELECT window_end, COUNT(*) AS cnt FROM HOP('events', 'ts', INTERVAL '1 day') GROUP BY window_end", DAY)
    days = F.datediff("ts", F.lit("2024-01-01"))
    batch = F.when((F.col("event_id") % 4 == 0) | (days < 10), F.when(days < 20, 0).otherwise(2)).when(days < 20, 1).otherwise(2)
    return _replay(spark, d, app, batch, dt.datetime(2024, 1, 1))[1].all(spark, "window_end timestamp_ntz, cnt long").select("window_end", "cnt")


def records_trigger_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One snapshot of all rows so far per batch."""
    app = _events_only("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
    batch = F.least(F.floor(F.datediff("ts", F.lit("2024-01-01")) / 10), F.lit(2))
    return _replay(spark, d, app, batch)[1].all(spark, "event_type string, n long").select("event_type", "n", "fire")


def expiration_retained(spark: SparkSession, d: str) -> DataFrame:
    """The rows that are kept after all windows have fired."""
    app = _events_only("SELECT window_end, COUNT(*) AS cnt FROM HOP('events', 'ts', INTERVAL '2 days') GROUP BY window_end", DAY)
    batch = F.least(F.floor(F.datediff("ts", F.lit("2024-01-01")) / 10), F.lit(2))
    runner, _ = _replay(spark, d, app, batch, dt.datetime(2024, 1, 1))
    rows = runner.retained("events")
    return (tables(spark, d, "events").limit(0) if rows is None else rows).select("event_id", "ts")


def watermark_min_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """The watermark of an output over one source per event type; null while one of them has no time."""
    events, app = tables(spark, d, "events"), Pipeline()
    types = [r["event_type"] for r in events.select("event_type").distinct().collect()]
    sources = {f"events_{k}": events.where(F.col("event_type").eqNullSafe(t)) for k, t in enumerate(types)}
    for name in sources:
        app.source(name, ts_col="ts")
    app.output("out", " UNION ALL ".join(f"SELECT ts FROM {name}" for name in sources)).trigger(records=1)
    mark, kind = final_watermark(app, "out", sources), dict(events.dtypes)["ts"]
    return spark.range(1).select((F.lit(None).cast(kind) if mark is None else instant(mark, kind)).alias("watermark"))


def key_placement(spark: SparkSession, d: str) -> DataFrame:
    """In how many partitions each user's events lie after a repartition by user, and whether that is the foreseen one."""
    placed = partitioning.repartition(tables(spark, d, "events"), ["user_id"], 7).withColumn("at", F.spark_partition_id())
    same = F.min((F.col("at") == partitioning.partition_id(["user_id"], 7)).cast("int")).alias("foreseen")
    return placed.groupBy("user_id").agg(F.count_distinct("at").alias("n_partitions"), same, F.count("*").alias("n"))


def broadcast_join(spark: SparkSession, d: str) -> DataFrame:
    """A join with a source that every partition needs, broadcast only because its size is known."""
    app = Pipeline()
    app.source("customer", partition_by=["c_nationkey"])
    app.source("nation", partition_by=[])
    app.output("out", "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name").trigger(records=1)
    return app.dataframe(spark, "out", {t: tables(spark, d, t) for t in ("customer", "nation")})


def salted_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A hot key counted in two steps."""
    first = partitioning.salted(tables(spark, d, "events"), ["event_type"], 4, F.col("event_id")).groupBy("event_type", "salt").agg(F.count("*").alias("n"), F.max("value").alias("largest"))
    return first.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))


QUERIES |= {f.__name__: f for f in (key_placement, broadcast_join, salted_aggregate, late_drop_replay, records_trigger_snapshots, expiration_retained, watermark_min_of_sources)}
_DAYS = "date_diff('day', date '2024-01-01', ts::date)"
ORACLES |= {
    "key_placement": "select user_id, cast(1 as bigint) as n_partitions, 1::int as foreseen, count(*) as n from events group by user_id",
    "broadcast_join": "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name",
    "salted_aggregate": "select event_type, count(*) as n, max(value) as largest from events group by event_type",
    "late_drop_replay": f"""with b as (select *, case when event_id % 4 = 0 or {_DAYS} < 10 then (case when {_DAYS} < 20 then 0 else 2 end) when {_DAYS} < 20 then 1 else 2 end as batch from events),
m as (select k, date_trunc('day', max(ts)) as mark from b, range(0, 3) r(k) where batch <= k group by k),
w as (select time_bucket(interval 1 day, ts) + interval 1 day as window_end, batch from b)
select window_end, count(*) as cnt from w join (select e, min(k) as k from (select distinct window_end as e from w), m where mark >= e group by e) f on window_end = e and batch <= k group by window_end""",
    "records_trigger_snapshots": f"select event_type, count(*) as n, cast(k + 1 as bigint) as fire from (select *, least({_DAYS} // 10, 2) as batch from events), range(0, 3) r(k) where batch <= k group by event_type, k",
    "expiration_retained": "select event_id, ts from events where ts >= (select date_trunc('day', max(ts)) - interval 2 day from events)",
    "watermark_min_of_sources": "select min(m) as watermark from (select max(ts) as m from events group by event_type)",
}


# -- SQL of outputs

_add("order_by_nulls_last", "SELECT o_orderkey, NULLIF(o_orderpriority, '1-URGENT') AS priority, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY NULLIF(o_orderpriority, '1-URGENT') DESC, o_orderkey) AS BIGINT) AS pos FROM orders ORDER BY priority, o_orderkey")
ORACLES["order_by_nulls_last"] = ORACLES["order_by_nulls_last"].replace("'1-URGENT') DESC, o_orderkey)", "'1-URGENT') DESC NULLS LAST, o_orderkey)")
_add("limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
_add("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
_add("union_all", "SELECT c_nationkey AS k, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
_add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_add("intersect_rows", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
_add("except_rows", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
_add("semi_join", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
_add("anti_join", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
_add("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_add("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
_add("left_join", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_add("right_join", "SELECT n_name, COUNT(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
_add("full_join", "SELECT COALESCE(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k")
_add("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_add("star_join", "SELECT r_name, c_mktsegment, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment")
_add("self_join_diamond", "SELECT a.user_id, a.n, b.largest FROM (SELECT user_id, COUNT(*) AS n FROM paid GROUP BY user_id) a JOIN (SELECT user_id, MAX(value) AS largest FROM events GROUP BY user_id) b ON a.user_id = b.user_id", "with paid as (select * from events where value > 0) select a.user_id, a.n, b.largest from (select user_id, count(*) as n from paid group by user_id) a join (select user_id, max(value) as largest from events group by user_id) b on a.user_id = b.user_id", views={"paid": "SELECT * FROM events WHERE value > 0"})
_LAST = "LAST_VALUE(CASE WHEN event_type = 'purchase' THEN event_id END{inside}){outside} OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_add(  # the last purchase of the same user at or before each other event: one shuffle and a running last value, no range join
    "asof_join",
    f"SELECT event_id, last_purchase FROM (SELECT event_id, event_type, {_LAST.format(inside='', outside=' IGNORE NULLS')} AS last_purchase FROM events) WHERE event_type <> 'purchase' AND last_purchase IS NOT NULL",
    "select event_id, last_purchase from (select e.event_id, p.event_id as last_purchase, row_number() over (partition by e.event_id order by p.ts desc, p.event_id desc) as rn from events e join events p on e.user_id = p.user_id and p.event_type = 'purchase' and p.ts <= e.ts where e.event_type <> 'purchase') where rn = 1",
)
_add(
    "interval_join",
    "SELECT a.event_id, b.event_id AS soon_after FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR",
    "select a.event_id, b.event_id as soon_after from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 1 hour",
)
_add("lateral_join", "SELECT n_name, c.richest FROM nation, LATERAL (SELECT MAX(c_acctbal) AS richest FROM customer WHERE c_nationkey = n_nationkey) c")
_add(
    "hop_join_table",
    "SELECT c_mktsegment, window_end, COUNT(*) AS n FROM HOP('events', 'ts', INTERVAL '1 day') e JOIN customer c ON e.user_id = c.c_custkey GROUP BY c_mktsegment, window_end",
    f"select c_mktsegment, window_end, count(*) as n from {_windows('events', 'ts', 24, 24)} e join customer c on e.user_id = c.c_custkey group by all",
    DAY,
)
_GROUPED = "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity FROM lineitem GROUP BY"
_add("rollup", f"{_GROUPED} ROLLUP (l_returnflag, l_linestatus)")
_add("cube", f"{_GROUPED} CUBE (l_returnflag, l_linestatus)")
_add("grouping_sets", f"{_GROUPED} GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_add("having", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 20")
_add("global_aggregate", "SELECT COUNT(*) AS n, MIN(ts) AS first_ts, MAX(ts) AS last_ts, ROUND(AVG(value), 6) AS mean_value FROM events")
_add("count_distinct", "SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(value) AS vals FROM events GROUP BY event_type")
_add("conditional_aggregates", "SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'purchase') AS bought, ROUND(SUM(CASE WHEN value > 50 THEN value ELSE 0 END), 2) AS large FROM events GROUP BY user_id")
_add("statistics", "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS v, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag")
_add("exact_percentiles", "SELECT o_orderpriority, ROUND(PERCENTILE(o_totalprice, 0.5), 4) AS p50, ROUND(PERCENTILE(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority", "select o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(quantile_cont(o_totalprice, 0.9), 4) as p90 from orders group by o_orderpriority")
_add("list_aggregate", "SELECT n_regionkey, ARRAY_JOIN(ARRAY_SORT(COLLECT_LIST(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "select n_regionkey, array_to_string(list_sort(list(n_name)), '|') as names from nation group by n_regionkey")
_RANKS = ", ".join(f"CAST({f} OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS {n}" for f, n in (("RANK()", "r"), ("DENSE_RANK()", "dr"), ("NTILE(4)", "nt"), ("LAG(o_orderkey)", "prev"), ("LEAD(o_orderkey)", "next")))
_add("rank_lag_frames", f"SELECT o_orderkey, {_RANKS}, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f FROM orders")
_add("range_frame", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS recent FROM orders")
_add("qualify_topn", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
_add("case_in_like", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'middle' ELSE 'large' END AS class FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') OR p_name LIKE '%1%'")
_add("string_fns", "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name) AS n, SUBSTRING(c_name, 1, 4) AS s, CONCAT(c_mktsegment, '-', c_name) AS j, REPLACE(c_name, 'C', 'K') AS r, REVERSE(c_mktsegment) AS v, LPAD(c_mktsegment, 12, '*') AS p, TRIM(CONCAT(' ', c_name, ' ')) AS t FROM customer")
ORACLES["string_fns"] = ORACLES["string_fns"].replace("LENGTH(c_name)", "CAST(LENGTH(c_name) AS INTEGER)")
_add("regex_hash_fns", "SELECT c_custkey, REGEXP_REPLACE(c_name, '[0-9]+', '#') AS masked, MD5(c_name) AS digest FROM customer", "select c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') as masked, md5(c_name) as digest from customer")
_add("date_fns", "SELECT event_id, CAST(YEAR(ts) AS BIGINT) AS y, CAST(MONTH(ts) AS BIGINT) AS m, CAST(DAY(ts) AS BIGINT) AS d, CAST(HOUR(ts) AS BIGINT) AS h, CAST(QUARTER(ts) AS BIGINT) AS q, DATE_FORMAT(ts, 'yyyy-MM-dd HH:mm') AS s, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ts + INTERVAL '90' MINUTE AS later FROM events")
ORACLES["date_fns"] = ORACLES["date_fns"].replace("DATE_FORMAT(ts, 'yyyy-MM-dd HH:mm')", "strftime(ts, '%Y-%m-%d %H:%M')")
_add("epoch_of_timestamp", "SELECT event_id, EXTRACT(EPOCH FROM ts) AS seconds FROM events", "select event_id, extract(epoch from ts)::double as seconds from events")
_add("math_fns", "SELECT l_orderkey, l_linenumber, CAST(FLOOR(l_extendedprice) AS INTEGER) AS f, CAST(CEIL(l_extendedprice) AS BIGINT) AS c, CAST(l_extendedprice AS INTEGER) AS rounded, ROUND(SQRT(l_quantity), 6) AS s, ABS(l_discount - 0.05) AS a, l_linenumber % 3 AS m, GREATEST(l_tax, l_discount) AS g FROM lineitem")
ORACLES["math_fns"] = ORACLES["math_fns"].replace("ABS(l_discount - 0.05)", "ABS(l_discount - 0.05::DOUBLE)")
_add("casts", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, o_totalprice::INTEGER::VARCHAR AS w, (o_totalprice / 2)::BIGINT AS half, (o_totalprice > 100000)::INTEGER AS large, CAST(o_totalprice AS BIGINT) AS whole FROM orders")
_add("json_fns", "SELECT event_id, GET_JSON_OBJECT(props, '$.k') AS k, props IS NULL AS missing FROM events", "select event_id, json_extract_string(props, '$.k') as k, props is null as missing from events")
_add("array_fns", "SELECT vec_id, CAST(SIZE(embedding) AS BIGINT) AS n, embedding[0] AS first_value, ROUND(AGGREGATE(embedding, CAST(0 AS DOUBLE), (a, x) -> a + x * x), 4) AS norm2 FROM embeddings", "select vec_id, len(embedding) as n, embedding[1] as first_value, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as norm2 from embeddings")
_add("generate_series", "SELECT n_nationkey, i FROM nation, LATERAL GENERATE_SERIES(2, n_regionkey, 1) AS t(i)", "select n_nationkey, unnest(generate_series(2, n_regionkey, 1))::int as i from nation")
_add(  # the same text in both dialects
    "dialect_aggregates",
    """SELECT event_type, ARG_MAX(event_id, value) AS dearest, ARG_MIN(user_id, ts) AS first_user, COUNT(*) FILTER (value > 50) AS large, QUANTILE_CONT(value, 0.25) AS q25,
ARRAY_TO_STRING(LIST_SORT(LIST(CASE WHEN value > 99 THEN event_id END)), ',') AS ids, CAST(SUM(user_id // 7) AS BIGINT) AS sevenths FROM events GROUP BY event_type""".replace("LIST_SORT", "ARRAY_SORT"),
    """select event_type, arg_max(event_id, value) as dearest, arg_min(user_id, ts) as first_user, count(*) filter (value > 50) as large, quantile_cont(value, 0.25) as q25,
array_to_string(list_sort(list(case when value > 99 then event_id end)), ',') as ids, cast(sum(user_id // 7) as bigint) as sevenths from events group by event_type""",
)
_add(
    "dialect_scalars",
    """SELECT event_id, STRFTIME(ts, '%Y-%m-%d at %H:%M:%S') AS s, EPOCH_US(ts) AS us, EPOCH_MS(ts) AS ms, TIME_BUCKET(INTERVAL '15 minutes', ts) AS quarter, DATE_DIFF('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS hours,
REGEXP_MATCHES(event_type, '^p') AS starts_with_p, JSON_EXTRACT_STRING(props, '$.k') AS k, STRPTIME(STRFTIME(ts, '%Y/%m/%d'), '%Y/%m/%d') AS day FROM (SELECT * EXCLUDE (value) FROM events)""",
)
_add("unnest_lists", "SELECT vec_id, UNNEST(embedding) AS x FROM embeddings")
_add("cte_chain", "WITH a AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey, t FROM a WHERE t > 100000) SELECT c_mktsegment, COUNT(*) AS n FROM b JOIN customer ON b.o_custkey = c_custkey GROUP BY c_mktsegment")
_add("documents_by_source", "SELECT source, COUNT(*) AS n, CAST(SUM(LENGTH(text)) AS BIGINT) AS chars, MAX(LENGTH(text)) AS longest FROM documents GROUP BY source")
ORACLES["documents_by_source"] = ORACLES["documents_by_source"].replace("MAX(LENGTH(text))", "CAST(MAX(LENGTH(text)) AS INTEGER)")


_add(
    "session_windows",
    "SELECT user_id, session_window.start AS session_start, COUNT(*) AS n FROM events GROUP BY user_id, SESSION_WINDOW(ts, '2 hours')",
    """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as session_start, count(*) as n from s group by user_id, k""",
)
_add("map_fns", "SELECT event_id, m['a'] AS a, CAST(SIZE(m) AS BIGINT) AS n, ARRAY_JOIN(MAP_KEYS(m), '|') AS ks FROM (SELECT event_id, MAP('a', value, 'b', user_id) AS m FROM events)", "select event_id, m['a'] as a, cardinality(m)::bigint as n, array_to_string(map_keys(m), '|') as ks from (select event_id, map {'a': value, 'b': user_id::double} as m from events)")
_add(  # approximate answers differ from engine to engine: they must lie near the exact ones
    "approximate_aggregates",
    """SELECT event_type, ABS(APPROX_COUNT_DISTINCT(user_id, 0.02) - COUNT(DISTINCT user_id)) <= 0.1 * COUNT(DISTINCT user_id) AS distinct_near,
PERCENTILE_APPROX(value, 0.5, 10000) BETWEEN PERCENTILE(value, 0.49) - 0.01 AND PERCENTILE(value, 0.51) + 0.01 AS median_near, COUNT(*) AS n FROM events GROUP BY event_type""",
    "select event_type, true as distinct_near, true as median_near, count(*) as n from events group by event_type",
)
_add("union_by_sets", "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT ALL SELECT user_id FROM events WHERE event_type = 'error'")
_add("except_all_rows", "SELECT user_id FROM events WHERE event_type = 'click' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'error'")
