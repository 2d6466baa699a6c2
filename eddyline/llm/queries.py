"""Queries of the problems 3, 6, 8, 9 and 10, over whole tables; SQL can express problems 6 and 10, and what must hold of the results of 3, 8 and 9."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.functions import norm_id, tables
from eddyline.llm import distinct, mixing, packing, quantiles, spans
from eddyline.llm.tokens import DEFAULT_VOCABULARY, token_count
from eddyline.operators.repeats import first_copies
from eddyline.session import cut_lineage

CAPACITY = 4096
PROBABILITIES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    orders = tables(spark, d, "order_messages").select("order_id", "amount", "region", "order_time", "msg_offset")
    once = first_copies(orders, norm_id("order_id")).where("order_time is not null")
    return quantiles.sketches(once, F.col("amount"), norm_id("region").alias("region"), F.date_format("order_time", "yyyy-MM-dd").alias("order_day"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per region and day, and (order_day null) per region over the whole span from the daily sketches."""
    daily = cut_lineage(_daily_sketches(spark, d))
    whole = quantiles.merge(daily, "region").select("region", F.lit(None).cast("string").alias("order_day"), "sketch")
    return quantiles.percentiles(daily.unionByName(whole), PROBABILITIES)


def p3_bound(spark: SparkSession, d: str) -> DataFrame:
    """Per group of p3_percentiles, whether each answer's rank is within epsilon x n + 1 of the asked one, by counting the amounts below and up to it."""
    orders = tables(spark, d, "order_messages").select("order_id", "amount", "region", "order_time", "msg_offset")
    once = first_copies(orders, norm_id("order_id")).where("order_time is not null and amount is not null and not isnan(amount)")
    spans = F.explode(F.array(F.date_format("order_time", "yyyy-MM-dd"), F.lit(None).cast("string"))).alias("day")
    rows = once.select(norm_id("region").alias("place"), "amount", spans)
    found = p3_percentiles(spark, d)
    met = rows.join(found, rows["place"].eqNullSafe(found["region"]) & rows["day"].eqNullSafe(found["order_day"]))
    counts = [c for p in PROBABILITIES for c in (F.count_if(F.col("amount") < F.col(p)).alias(f"{p}_below"), F.count_if(F.col("amount") <= F.col(p)).alias(f"{p}_upto"))]
    tallied = met.groupBy("region", "order_day", "n", "epsilon").agg(F.count("*").alias("n_amounts"), *counts)
    checks = []
    for p, q in PROBABILITIES.items():
        rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n_amounts")))
        error = F.greatest(F.lit(0), F.col(f"{p}_below") + 1 - rank, rank - F.col(f"{p}_upto"))
        checks.append((error <= F.col("epsilon") * F.col("n_amounts") + 1).alias(f"{p}_within"))
    return tallied.select("region", "order_day", "n_amounts", (F.col("n") == F.col("n_amounts")).alias("all_counted"), *checks)


def p6_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    """Per day, region and both, with totals. Orders without time belong to no day but count in the totals over all days: their partial result is that of a null day, which has no row."""
    orders = tables(spark, d, "order_messages")
    partial = distinct.bitmaps(orders, norm_id("user_id"), F.date_format("order_time", "yyyy-MM-dd").alias("order_day"), norm_id("region").alias("region"))
    merged = distinct.combinations(partial, "order_day", "region").where("order_day is not null or order_day_total")
    return distinct.estimate(merged, "order_day", "region", "order_day_total", "region_total")


def p6_bound(spark: SparkSession, d: str) -> DataFrame:
    """Per group of p6_distinct_users the exact number, and whether the estimate lies within its error bound of it."""
    orders = tables(spark, d, "order_messages").select(norm_id("user_id").alias("who"), F.date_format("order_time", "yyyy-MM-dd").alias("day"), norm_id("region").alias("place"))
    once = orders.where("who is not null").distinct()
    totals = F.grouping("day").cast("boolean").alias("day_total"), F.grouping("place").cast("boolean").alias("place_total")
    exact = once.cube("day", "place").agg(F.count_distinct("who").alias("n_exact"), *totals).where("day is not null or day_total")
    found = p6_distinct_users(spark, d)
    same = [exact[a].eqNullSafe(found[b]) for a, b in (("day", "order_day"), ("place", "region"), ("day_total", "order_day_total"), ("place_total", "region_total"))]
    rows = exact.join(found, reduce(lambda a, b: a & b, same), "full")
    within = F.coalesce(F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.col("error_bound") * F.col("n_exact"), F.lit(False))
    return rows.select("order_day", "region", "order_day_total", "region_total", "n_exact", within.alias("within_bound"))


def _pieces(spark: SparkSession, d: str, vocabulary: str) -> DataFrame:
    texts = tables(spark, d, "documents").select("doc_id", "text").where("text <> ''")
    return cut_lineage(packing.pieces(texts.select("doc_id", token_count("text", vocabulary).alias("n")), F.col("doc_id"), F.col("n"), CAPACITY))


def p8_containers(spark: SparkSession, d: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    assigned = packing.assign(_pieces(spark, d, vocabulary), CAPACITY)
    return packing.containers(assigned, CAPACITY)


def p8_checks(spark: SparkSession, d: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """What must hold of the containers, in one row: every text once and whole, none over the capacity, none split that fits, and at most 1 % more containers than tokens need."""
    parts = _pieces(spark, d, vocabulary)
    filled = cut_lineage(packing.containers(packing.assign(parts, CAPACITY), CAPACITY))
    inside = filled.select(F.explode("contents").alias("c")).select("c.item_id", "c.piece", "c.length")
    by_text = inside.groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("piece").alias("n_pieces"), F.max("piece").alias("last"), F.sum("length").alias("tokens"), F.min("length").alias("least"))
    wanted = parts.groupBy("item_id").agg(F.sum("length").alias("measured"))
    texts = wanted.join(by_text, "item_id", "full").agg(
        F.count("*").alias("n_texts"),
        F.count_if(~F.col("tokens").eqNullSafe(F.col("measured"))).alias("n_not_whole"),
        F.count_if((F.col("n") != F.col("n_pieces")) | (F.col("n") != F.col("last") + 1)).alias("n_repeated"),
        F.count_if((F.col("n") > 1) & (F.col("tokens") <= CAPACITY)).alias("n_split_though_fitting"),
    )
    fits = (F.sum("n_tokens") + CAPACITY - 1) / CAPACITY
    whole = filled.agg(F.count_if(F.col("n_tokens") > CAPACITY).alias("n_over_capacity"), (F.count("*") <= 1.01 * F.coalesce(F.floor(fits), F.lit(0)) + 1).alias("few_containers"))
    return texts.join(whole)  # one row each


def _mix(spark: SparkSession, d: str, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    goals = mixing.targets(tables(spark, d, "mix_targets"))
    texts = tables(spark, d, "documents").select("doc_id", "source", "text").where("text <> '' and doc_id is not null")
    wanted = texts.join(goals.select("source"), "source", "left_semi").select("doc_id", "source", "text", token_count("text", vocabulary).alias("n_tokens")).where("n_tokens > 0")
    sized = cut_lineage(wanted.select("doc_id", "source", "n_tokens", mixing.quality_weight(F.col("text"), F.col("n_tokens")).alias("weight")))
    planned = mixing.plan(sized, goals)
    return mixing.select(sized, planned), planned


def p9_mix(spark: SparkSession, d: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    return _mix(spark, d, vocabulary)[0]


def p9_shares(spark: SparkSession, d: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    return mixing.shares(*_mix(spark, d, vocabulary))


def p9_checks(spark: SparkSession, d: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """What must hold of the mix, per source: no document over the cap, all complete epochs before the fraction, tokens within one document of the budget."""
    chosen, planned = _mix(spark, d, vocabulary)
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("n_tokens").alias("largest"), F.min("repeats").alias("fewest"), F.max("repeats").alias("most"), F.count("*").alias("n_docs"))
    rows = planned.join(used, "source", "left").fillna(0, ["tokens", "largest", "fewest", "most", "n_docs"])
    epochs = (F.col("most") <= F.col("epochs") + 1) & (F.col("fewest") >= F.col("epochs")) & ((F.col("epochs") == 0) | (F.col("n_docs") == F.col("n_available")))
    near = F.abs(F.col("tokens") - F.col("budget")) <= F.col("largest") + 1e-6 * F.col("budget")
    return rows.select("source", "target_share", "max_repeats", "n_available", (F.col("most") <= F.col("max_repeats")).alias("cap_kept"), epochs.alias("epochs_first"), near.alias("near_budget"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(tables(spark, d, "documents"), F.col("doc_id"), F.col("text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d)


def p10_shared_part(spark: SparkSession, d: str) -> DataFrame:
    """Per document with text: its number of shared spans, the characters they cover and their part of the text."""
    covered = _spans(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    sizes = tables(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars")).where("n_chars > 0")
    rows = sizes.join(covered, "doc_id", "left").fillna(0, ["n_spans", "shared_chars"])
    return rows.withColumn("shared_part", F.col("shared_chars") / F.col("n_chars"))


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_bound, p6_distinct_users, p6_bound, p8_containers, p8_checks, p9_mix, p9_shares, p9_checks, p10_found, p10_shared_part)}
_P6_HASHED = """select strftime(order_time at time zone 'UTC', '%Y-%m-%d') as order_day, nullif(lower(trim(region)), '') as region, ('0x' || substr(md5(nullif(lower(trim(user_id)), '')), 1, 15))::bigint as h
from order_messages where nullif(lower(trim(user_id)), '') is not null"""
_P10_RUNS = """with t as (select doc_id, text from documents where doc_id is not null and length(text) >= 250),
g as (select doc_id, p, hash(substr(text, p + 1, 250)) as h from (select doc_id, text, unnest(range(0, length(text) - 249)) as p from t)),
x as (select distinct doc_id, p from g semi join (select h from g group by h having min(doc_id) <> max(doc_id)) using (h)),
r as (select *, case when p <= lag(p) over (partition by doc_id order by p) + 250 then 0 else 1 end as new from x),
k as (select *, sum(new) over (partition by doc_id order by p) as k from r),
runs as (select doc_id, min(p) as start_pos, max(p) + 250 as end_pos from k group by doc_id, k)"""
ORACLES = {
    # the groups and their sizes; that the answers lie within the bound is what the query must find
    "p3_bound": """with o as (select nullif(lower(trim(region)), '') as region, strftime(order_time at time zone 'UTC', '%Y-%m-%d') as day from
  (select *, row_number() over (partition by nullif(lower(trim(order_id)), '') order by msg_offset) as rn from order_messages)
  where (rn = 1 or nullif(lower(trim(order_id)), '') is null) and order_time is not null and amount is not null and not isnan(amount))
select region, day as order_day, count(*) as n_amounts, true as all_counted, true as p50_within, true as p90_within, true as p95_within, true as p99_within from o group by grouping sets ((region, day), (region))""",
    "p6_bound": """with o as (select strftime(order_time at time zone 'UTC', '%Y-%m-%d') as order_day, nullif(lower(trim(region)), '') as region, nullif(lower(trim(user_id)), '') as who from order_messages)
select order_day, region, grouping(order_day) = 1 as order_day_total, grouping(region) = 1 as region_total, count(distinct who) as n_exact, true as within_bound from o where who is not null group by cube (order_day, region) having order_day is not null or grouping(order_day) = 1""",
    "p8_checks": "select count(*) as n_texts, 0::bigint as n_not_whole, 0::bigint as n_repeated, 0::bigint as n_split_though_fitting, 0::bigint as n_over_capacity, true as few_containers from documents where text <> ''",
    "p9_checks": """select t.source, t.target_share, t.max_repeats, (select count(*) from documents d where d.source = t.source and d.text <> '' and d.doc_id is not null) as n_available,
true as cap_kept, true as epochs_first, true as near_budget from mix_targets t""",
    # all windows of 250 characters
    "p10_found": f"{_P10_RUNS} select doc_id, start_pos, end_pos from runs",
    "p10_shared_part": f"""{_P10_RUNS}, c as (select doc_id, count(*) as n_spans, cast(sum(end_pos - start_pos) as bigint) as shared_chars from runs group by 1)
select d.doc_id, length(text) as n_chars, coalesce(n_spans, 0) as n_spans, coalesce(shared_chars, 0) as shared_chars, coalesce(shared_chars, 0) / length(text) as shared_part
from documents d left join c on d.doc_id = c.doc_id where length(text) > 0""",
    # the same estimate from the distinct places of each level
    "p6_distinct_users": f"""with p as (select *, case when h >> 16 = 0 then {distinct.LEVELS - 1} else {distinct.LEVELS} - length(bin(h >> 16)) end as level, h & {distinct.BITS - 1} as place from ({_P6_HASHED})),
z as (select order_day, region, grouping(order_day) = 1 as order_day_total, grouping(region) = 1 as region_total, level, count(distinct place) as z from p
  group by grouping sets ((order_day, region, level), (order_day, level), (region, level), (level)) having order_day is not null or grouping(order_day) = 1),
b as (select order_day, region, order_day_total, region_total, coalesce(max(case when z > {distinct.SATURATED * distinct.BITS} then level end) + 1, 0) as base from z group by all)
select b.order_day, b.region, b.order_day_total, b.region_total, cast(round(pow(2.0, any_value(base)) * sum(case when level >= base then {distinct.BITS} * ln({distinct.BITS} / greatest(0.5, {distinct.BITS} - z)) else 0 end)) as bigint) as n_distinct,
{distinct.ERROR_BOUND}::double as error_bound from z join b on z.order_day is not distinct from b.order_day and z.region is not distinct from b.region and z.order_day_total = b.order_day_total and z.region_total = b.region_total group by 1, 2, 3, 4"""
}
