"""Queries of the message-data problems 1, 2, 4, 5 and 7, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eddyline.functions import norm_id, tables
from eddyline.functions.columns import HOUR_US
from eddyline.operators import gap_tree, late, orphans, repeats, rolling
from eddyline.session import cut_each, cut_lineage

INACTIVE_US = 1_800_000_000
LATENESS_US = 6 * HOUR_US
_TIMES = {"activity_log": "event_time", "order_messages": "order_time", "delivery_messages": "delivery_time"}


def _tree(spark: SparkSession, d: str, record_id: str | None = None) -> DataFrame:
    return gap_tree.gap_tree(tables(spark, d, "activity_log"), norm_id("user_id"), F.unix_micros("event_time"), record_id and F.col(record_id))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return gap_tree.cut(_tree(spark, d), INACTIVE_US).select(F.col("entity").alias("user_id"), "start_us", "end_us")


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    met = gap_tree.cut(_tree(spark, d, "id"), INACTIVE_US)
    return met.select(F.col("entity").alias("user_id"), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), F.col("n_events").alias("n_ids"))


def p1_gap_settings(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per gap setting, all cut from one stored tree."""
    settings = F.explode(F.array(*[F.lit(m * 60_000_000).cast("long") for m in (5, 15, 30, 60, 240)])).alias("gap_us")
    nodes = _tree(spark, d).select("*", settings).where("height_us <= gap_us and (parent_us is null or parent_us > gap_us)")
    return nodes.groupBy("gap_us").agg(F.count("*").alias("n_sessions"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"), F.max("n_events").alias("most_times"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    parts = [repeats.message_keys(tables(spark, d, t), t, norm_id(c)) for t, c in (("order_messages", "order_id"), ("delivery_messages", "delivery_id"))]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeats(_messages(spark, d)).select(F.col("src").alias("src_table"), "msg_offset")


def p2_unique_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = tables(spark, d, "order_messages").where(norm_id("order_id").isNotNull())
    surplus = repeats.repeats(repeats.message_keys(orders, "order_messages", norm_id("order_id"))).select("msg_offset")
    kept = orders.join(surplus, "msg_offset", "left_anti")
    return kept.select(norm_id("order_id").alias("order_id"), norm_id("user_id").alias("user_id"), "msg_offset", "batch_id")


def _orders_once(spark: SparkSession, d: str) -> DataFrame:
    return repeats.first_copies(tables(spark, d, "order_messages").select("order_id", "user_id", "product_id", "amount", "region", "order_time", "msg_offset"), norm_id("order_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    orders = tables(spark, d, "order_messages")
    per_day = rolling.daily(orders, norm_id("user_id"), F.to_date("order_time"), F.col("amount"))
    quiet = rolling.trailing(per_day, (7,)).where("n_rows = 0 and rows_7 > 0")
    return quiet.select(F.col("entity").alias("user_id"), F.date_format("day", "yyyy-MM-dd").alias("order_day"))


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    per_day = rolling.daily(_orders_once(spark, d), norm_id("user_id"), F.to_date("order_time"), F.col("amount"))
    rows = rolling.trailing(per_day)
    cents = [F.round(F.col(c), 2).alias(c) for c in ("total_7", "total_30")]
    means = [F.when(F.col(f"amounts_{k}") > 0, F.round(F.col(f"total_{k}"), 2) / F.col(f"amounts_{k}")).alias(f"average_{k}") for k in (7, 30)]
    return rows.select(F.col("entity").alias("user_id"), F.date_format("day", "yyyy-MM-dd").alias("order_day"), F.col("n_rows").alias("n_orders"), "rows_7", "rows_30", *cents, *means)


def _edges(spark: SparkSession, d: str) -> list[orphans.Edge]:
    orders, deliveries, feed = (tables(spark, d, t) for t in ("order_messages", "delivery_messages", "product_feed"))
    # each table is read once; what the edges need of it is kept
    kept = orders.select(norm_id("order_id").alias("record_id"), norm_id("product_id").alias("ref_id"), F.col("order_time").alias("at")).where("record_id is not null").distinct()
    kept, to_order = cut_each([kept, orphans.references(deliveries, norm_id("delivery_id"), norm_id("order_id"), F.col("delivery_time"))])
    to_product = kept.where("ref_id is not null")
    alive = orphans.lifetimes(feed, norm_id("product_id"), F.col("event_time"), F.col("change_op") != "delete")
    return [
        orphans.Edge("delivery_messages", "order_messages", to_order, orphans.missing(to_order, kept, F.col("record_id"))),
        orphans.Edge("order_messages", "product_feed", to_product, orphans.missing_then(to_product, alive)),
    ]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    direct = orphans.cascade(_edges(spark, d)).where("kind = 'direct'")
    return direct.select("src_table", "record_id", "ref_id").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("at", "yyyy-MM-dd").alias("day")
    rows = orphans.cascade(_edges(spark, d)).select("src_table", "record_id", "ref_id", day, "kind").distinct()
    direct, inherited = (F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("direct", "inherited"))
    return rows.groupBy("src_table", "day").agg(direct, inherited)


def p5_inherited(spark: SparkSession, d: str) -> DataFrame:
    """The references that lead to an orphaned record, directly or through others, with the number of steps."""
    heirs = orphans.cascade(_edges(spark, d)).where("kind = 'inherited'")
    return heirs.select("src_table", "record_id", "ref_id", "depth").distinct()


def p5_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of a graph in which order messages have two foreign keys: their product, and their user, who must have an event in the activity log."""
    orders, events = tables(spark, d, "order_messages"), tables(spark, d, "activity_log")
    to_user = cut_lineage(orphans.references(orders, norm_id("order_id"), norm_id("user_id"), F.col("order_time")))
    edges = [*_edges(spark, d), orphans.Edge("order_messages", "activity_log", to_user, orphans.missing(to_user, events, norm_id("user_id")))]
    return orphans.cascade(edges).groupBy("src_table", "parent", "kind", "depth").agg(F.count_distinct("record_id", "ref_id").alias("n"))


def p5_self_reference(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of a table that refers to itself: of the order messages of a user and clock hour, the k-th refers to the one at k / 2, and is orphaned by its product too."""
    orders = tables(spark, d, "order_messages").select(norm_id("user_id").alias("user_id"), norm_id("product_id").alias("product_id"), "msg_offset", F.col("order_time").alias("at"))
    orders = orders.where("user_id is not null and at is not null and msg_offset is not null").withColumn("hour", F.floor(F.unix_micros("at") / HOUR_US))
    k = F.row_number().over(Window.partitionBy("user_id", "hour").orderBy("msg_offset"))
    name = lambda place: F.concat_ws("|", "user_id", "hour", place)
    linked = cut_lineage(orders.withColumn("k", k).select(name("k").alias("record_id"), name((F.col("k") / 2).cast("int")).alias("before"), "product_id", "k", "at"))
    to_self = linked.where("k > 1").select("record_id", F.col("before").alias("ref_id"), "at")
    to_product = linked.where("product_id is not null").select("record_id", F.col("product_id").alias("ref_id"), "at")
    alive = orphans.lifetimes(tables(spark, d, "product_feed"), norm_id("product_id"), F.col("event_time"), F.col("change_op") != "delete")
    edges = [orphans.Edge("order_messages", "order_messages", to_self, to_self.limit(0)), orphans.Edge("order_messages", "product_feed", to_product, orphans.missing_then(to_product, alive))]
    return orphans.cascade(edges).groupBy("parent", "kind", "depth").agg(F.count("*").alias("n"))


def _timed(spark: SparkSession, d: str, *more: str) -> DataFrame:
    parts = [tables(spark, d, t).select(F.lit(t).alias("src"), "msg_offset", "batch_id", F.unix_micros(c).alias("us"), *more) for t, c in _TIMES.items()]
    return reduce(DataFrame.unionByName, parts)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return late.judged(_timed(spark, d), LATENESS_US).where("late").select(F.col("src").alias("src_table"), "msg_offset").distinct()


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    kept = late.judged(_timed(spark, d), LATENESS_US).where("not late")
    state = late.multiset(kept.select(F.col("src").alias("src_table"), F.col("period_us").alias("hour_us")), ["src_table", "hour_us"], F.lit(None).cast("double"))
    return late.records(state, ["src_table", "hour_us"]).withColumnRenamed("n_records", "n")


def p7_order_values(spark: SparkSession, d: str) -> DataFrame:
    """Exact median, distinct amounts and extremes of each hour's accepted order messages, from the multiset state."""
    orders = tables(spark, d, "order_messages").select(F.lit("order_messages").alias("src"), "msg_offset", "batch_id", F.unix_micros("order_time").alias("us"), "amount")
    kept = late.judged(orders, LATENESS_US).where("not late")
    state = late.multiset(kept.withColumnRenamed("period_us", "hour_us"), ["hour_us"], F.when(~F.isnan("amount"), F.col("amount")))
    return late.derive(state, ["hour_us"]).select("hour_us", "n_records", "n_values", "n_distinct", "smallest", "largest", "median")


def p7_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Per hour of order messages, what it held when the watermark without lateness passed its end, and what it holds with the late messages merged in: records, distinct amounts and median."""
    orders = tables(spark, d, "order_messages").select(F.lit("order_messages").alias("src"), "msg_offset", "batch_id", F.unix_micros("order_time").alias("us"), "amount")
    kept = late.judged(orders, LATENESS_US).where("not late")
    corrects = F.coalesce(F.col("period_us") + HOUR_US <= F.col("watermark_us") + LATENESS_US, F.lit(False))
    parts = late.multiset(kept.withColumn("corrects", corrects).withColumnRenamed("period_us", "hour_us"), ["hour_us", "corrects"], F.when(~F.isnan("amount"), F.col("amount")))
    parts = cut_lineage(parts)
    first, delta = (parts.where(F.col("corrects") == c).drop("corrects") for c in (False, True))
    after = late.derive(late.merge(first, delta, ["hour_us"]), ["hour_us"])
    before = late.derive(first, ["hour_us"]).select("hour_us", *[F.col(c).alias(f"{c}_before") for c in ("n_records", "n_distinct", "median")])
    rows = after.select("hour_us", "n_records", "n_distinct", "median").join(before, "hour_us", "left")
    return rows.fillna(0, ["n_records_before", "n_distinct_before"])


_U, _ID = "nullif(lower(trim(user_id)), '')", "nullif(lower(trim({})), '')"
_SESSIONS = f"""with e as (select {_U} as user_id, epoch_us(event_time) as us, id from activity_log where {_U} is not null and event_time is not null),
g as (select *, case when us - lag(us) over w > {{gap}} or lag(us) over w is null then 1 else 0 end as new from e window w as (partition by user_id order by us)),
s as (select *, sum(new) over (partition by user_id order by us) as k from g)"""
_SURPLUS = "select '{t}' as src_table, msg_offset from (select msg_offset, row_number() over (partition by nullif(lower(trim({c})), '') order by msg_offset) as rn from {t} where nullif(lower(trim({c})), '') is not null) where rn > 1"
_ONCE = """o as (select * from (select *, row_number() over (partition by nullif(lower(trim(order_id)), '') order by msg_offset) as rn from order_messages) where rn = 1 or nullif(lower(trim(order_id)), '') is null)"""
_ORPHANS = """with orders as (select distinct nullif(lower(trim(order_id)), '') as record_id, nullif(lower(trim(product_id)), '') as ref_id, order_time as "at" from order_messages),
feed as (select nullif(lower(trim(product_id)), '') as ref_id, event_time, max(case when change_op = 'delete' then 1 else 0 end) as dead from product_feed group by 1, 2),
bad_orders as (select o.* from orders o asof left join feed f on o.ref_id = f.ref_id and o."at" >= f.event_time
  where o.record_id is not null and o.ref_id is not null and o."at" is not null and coalesce(f.dead, 1) = 1),
deliveries as (select distinct nullif(lower(trim(delivery_id)), '') as record_id, nullif(lower(trim(order_id)), '') as ref_id, delivery_time as "at" from delivery_messages),
bad_deliveries as (select * from deliveries where record_id is not null and ref_id is not null and ref_id not in (select record_id from orders where record_id is not null)),
direct as (select 'order_messages' as src_table, * from bad_orders union all select 'delivery_messages', * from bad_deliveries)"""


def _late_sql() -> str:
    parts = " union all ".join(f"select '{t}' as src, msg_offset, batch_id, epoch_us({c}) as us, {'amount' if t == 'order_messages' else 'null'} as amount from {t}" for t, c in _TIMES.items())
    return f"""with m as ({parts}), b as (select src, batch_id, max(us) as us from m group by 1, 2),
w as (select src, batch_id, max(us) over (partition by src order by batch_id rows between unbounded preceding and 1 preceding) - {LATENESS_US} as wm from b),
j as (select m.*, wm, us - us % {HOUR_US} as hour_us, coalesce(us - us % {HOUR_US} + {HOUR_US} <= wm, false) as late from m join w using (src, batch_id) where us is not null)"""


QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p1_gap_settings, p2_found, p2_unique_orders, p4_found, p4_rolling, p5_found, p5_report, p5_inherited, p5_two_keys, p5_self_reference, p7_found, p7_counts, p7_order_values, p7_corrections)}

ORACLES = {
    "p1_found": f"{_SESSIONS.format(gap=INACTIVE_US)} select user_id, min(us) as start_us, max(us) as end_us from s group by user_id, k",
    "p1_sessions": f"{_SESSIONS.format(gap=INACTIVE_US)} select user_id, min(us) as start_us, max(us) as end_us, max(us) - min(us) as duration_us, count(distinct id) as n_ids from s group by user_id, k",
    "p1_gap_settings": " union all ".join(
        f"select * from ({_SESSIONS.format(gap=m * 60_000_000)} select cast({m * 60_000_000} as bigint) as gap_us, count(*) as n_sessions, cast(sum(b - a) as bigint) as total_us, max(n) as most_times from (select min(us) as a, max(us) as b, count(distinct us) as n from s group by user_id, k))"
        for m in (5, 15, 30, 60, 240)
    ),
    "p2_found": f"{_SURPLUS.format(t='order_messages', c='order_id')} union all {_SURPLUS.format(t='delivery_messages', c='delivery_id')}",
    "p2_unique_orders": f"with {_ONCE} select nullif(lower(trim(order_id)), '') as order_id, {_U} as user_id, msg_offset, batch_id from o where nullif(lower(trim(order_id)), '') is not null",
    "p4_found": f"""with a as (select distinct {_U} as user_id, cast(order_time at time zone 'UTC' as date) as d from order_messages where {_U} is not null and order_time is not null),
q as (select distinct user_id, d + k::int as d from a, range(1, 7) t(k)) select user_id, strftime(d, '%Y-%m-%d') as order_day from q anti join a using (user_id, d)""",
    "p4_rolling": f"""with {_ONCE}, a as (select {_U} as user_id, cast(order_time at time zone 'UTC' as date) as d, count(*) as n, count(v) as m, sum(v) as total from (select *, case when not isnan(amount) then amount end as v from o) where {_U} is not null and order_time is not null group by 1, 2),
c as (select user_id, cast(unnest(generate_series(low, high + 29, interval 1 day)) as date) as day from (select user_id, min(d) as low, max(d) as high from a group by 1)),
r as (select c.user_id, c.day, sum(case when d = day then n else 0 end) as n_orders, sum(case when d > day - 7 then n else 0 end) as rows_7, sum(coalesce(n, 0)) as rows_30,
 sum(case when d > day - 7 then coalesce(total, 0) else 0 end) as t7, sum(coalesce(total, 0)) as t30, sum(case when d > day - 7 then m else 0 end) as m7, sum(coalesce(m, 0)) as m30
 from c left join a on a.user_id = c.user_id and a.d between c.day - 29 and c.day group by 1, 2)
select user_id, strftime(day, '%Y-%m-%d') as order_day, cast(n_orders as bigint) as n_orders, cast(rows_7 as bigint) as rows_7, cast(rows_30 as bigint) as rows_30,
 round(t7, 2) as total_7, round(t30, 2) as total_30, case when m7 > 0 then round(t7, 2) / m7 end as average_7, case when m30 > 0 then round(t30, 2) / m30 end as average_30 from r""",
    "p5_found": f"{_ORPHANS} select distinct src_table, record_id, ref_id from direct",
    "p5_report": f"""{_ORPHANS}, heirs as (select 'delivery_messages' as src_table, d.* from deliveries d where d.record_id is not null and d.ref_id in (select record_id from bad_orders)),
refs as (select distinct src_table, record_id, ref_id, strftime("at" at time zone 'UTC', '%Y-%m-%d') as day, kind from (select *, 'direct' as kind from direct union all select *, 'inherited' from heirs))
select src_table, day, count(*) filter (kind = 'direct') as n_direct, count(*) filter (kind = 'inherited') as n_inherited from refs group by 1, 2""",
    "p5_inherited": f"""{_ORPHANS} select distinct 'delivery_messages' as src_table, record_id, ref_id, 1::int as depth from deliveries
where record_id is not null and ref_id in (select record_id from bad_orders)""",
    "p5_two_keys": f"""{_ORPHANS}, users as (select distinct {_U} as user_id from activity_log), u as (select distinct nullif(lower(trim(order_id)), '') as record_id, {_U} as ref_id from order_messages),
bad_users as (select * from u where record_id is not null and ref_id is not null and ref_id not in (select user_id from users where user_id is not null)),
bad as (select record_id from bad_orders union select record_id from bad_users),
heirs as (select distinct record_id, ref_id from deliveries where record_id is not null and ref_id in (select record_id from bad))
select 'order_messages' as src_table, 'product_feed' as parent, 'direct' as kind, 0::int as depth, count(distinct (record_id, ref_id)) as n from bad_orders having n > 0
union all select 'order_messages', 'activity_log', 'direct', 0, count(distinct (record_id, ref_id)) as n from bad_users having n > 0
union all select 'delivery_messages', 'order_messages', 'direct', 0, count(distinct (record_id, ref_id)) as n from bad_deliveries having n > 0
union all select 'delivery_messages', 'order_messages', 'inherited', 1, count(distinct (record_id, ref_id)) as n from heirs having n > 0""",
    "p5_self_reference": f"""with recursive l as (select *, row_number() over (partition by user_id, hour order by msg_offset) as k from (select {_U} as user_id, nullif(lower(trim(product_id)), '') as ref_id, msg_offset,
  order_time as "at", epoch_us(order_time) // {HOUR_US} as hour from order_messages where {_U} is not null and order_time is not null and msg_offset is not null)),
feed as (select nullif(lower(trim(product_id)), '') as ref_id, event_time, max(case when change_op = 'delete' then 1 else 0 end) as dead from product_feed group by 1, 2),
bad as (select l.user_id, l.hour, l.k from l asof left join feed f on l.ref_id = f.ref_id and l."at" >= f.event_time where l.ref_id is not null and coalesce(f.dead, 1) = 1),
c as (select *, 0 as depth from bad union all select l.user_id, l.hour, l.k, c.depth + 1 from c join l on l.user_id = c.user_id and l.hour = c.hour and l.k > 1 and l.k // 2 = c.k),
h as (select user_id, hour, k, min(depth) as depth from c where depth > 0 group by 1, 2, 3)
select 'product_feed' as parent, 'direct' as kind, 0::int as depth, count(*) as n from bad having n > 0 union all select 'order_messages', 'inherited', depth::int, count(*) from h group by 3""",
    "p7_found": f"{_late_sql()} select distinct src as src_table, msg_offset from j where late",
    "p7_counts": f"{_late_sql()} select src as src_table, hour_us, count(*) as n from j where not late group by 1, 2",
    "p7_corrections": f"""{_late_sql()}, v as (select hour_us, case when not isnan(amount) then amount end as v, coalesce(hour_us + {HOUR_US} <= wm + {LATENESS_US}, false) as corrects from j where src = 'order_messages' and not late)
select hour_us, count(*) as n_records, count(distinct v) as n_distinct, quantile_disc(v, 0.5) as median, count(*) filter (not corrects) as n_records_before,
count(distinct v) filter (not corrects) as n_distinct_before, quantile_disc(v, 0.5) filter (not corrects) as median_before from v group by 1""",
    "p7_order_values": f"""{_late_sql()}, v as (select hour_us, case when not isnan(amount) then amount end as v from j where src = 'order_messages' and not late)
select hour_us, count(*) as n_records, count(v) as n_values, count(distinct v) as n_distinct, min(v) as smallest, max(v) as largest, quantile_disc(v, 0.5) as median from v group by 1""",
}
