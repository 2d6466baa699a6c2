"""Aggregates per period of event time, corrected as late records arrive, with a cut-off.

Before each batch the watermark is the largest event time of all earlier batches minus the allowed lateness. The running maximum over batches is a prefix
maximum in two steps (within blocks of batches, then over the blocks), so no task sees all batches. A record whose period ended at or before the watermark is late.

The state per period is a multiset: value -> count. Late records within the cut-off add to the counts (a negative weight takes away), states merge by addition, and count,
sum, distinct values, extremes and the exact median are derived again from the cumulative counts.

Nulls: records with null time belong to no period and are never late; a null value counts as a record but is not in the multiset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyline.functions.columns import HOUR_US, floor_to
from eddyline.session import cut_lineage

_BLOCK = 1024


def watermarks(messages: DataFrame, lateness_us: int) -> DataFrame:
    """messages: src, batch_id, us. Returns src, batch_id, watermark_us before that batch (null before the first)."""
    batches = cut_lineage(messages.groupBy("src", "batch_id").agg(F.max("us").alias("us"))).withColumn("block", F.floor(F.col("batch_id") / _BLOCK))  # a row per batch
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    blocks = batches.groupBy("src", "block").agg(F.max("us").alias("block_us"))
    blocks = blocks.select("src", "block", F.max("block_us").over(before("src").orderBy("block")).alias("earlier_us"))
    within = F.max("us").over(before("src", "block").orderBy("batch_id"))
    return batches.withColumn("within_us", within).join(blocks, ["src", "block"]).select("src", "batch_id", (F.greatest("within_us", "earlier_us") - lateness_us).alias("watermark_us"))


def judged(messages: DataFrame, lateness_us: int = 6 * HOUR_US, period_us: int = HOUR_US) -> DataFrame:
    """The messages with a time, with period_us (its start), watermark_us and late; columns of these names are replaced."""
    rows = messages.drop("period_us", "watermark_us", "late").where("us is not null").withColumn("period_us", floor_to(F.col("us"), period_us))
    marks = watermarks(messages, lateness_us)
    late = F.coalesce(F.col("period_us") + period_us <= F.col("watermark_us"), F.lit(False))
    return rows.join(marks, ["src", "batch_id"], "left").withColumn("late", late)


def multiset(rows: DataFrame, keys: list[str], value: str | Column, weight: Column | None = None) -> DataFrame:
    """The state: keys, value, n. Merging two states is merge()."""
    value = F.col(value) if isinstance(value, str) else value
    return rows.select(*keys, value.alias("value"), (F.lit(1) if weight is None else weight).cast("long").alias("n")).groupBy(*keys, "value").agg(F.sum("n").alias("n")).where("n <> 0")


def merge(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The state after late records: counts add up, values whose count falls to nothing leave."""
    return state.unionByName(delta).groupBy(*keys, "value").agg(F.sum("n").alias("n")).where("n <> 0")


def records(state: DataFrame, keys: list[str]) -> DataFrame:
    """Per period the number of records."""
    return state.groupBy(*keys).agg(F.sum("n").alias("n_records"))


def derive(state: DataFrame, keys: list[str]) -> DataFrame:
    """Per period: n_records, n_values, n_distinct, smallest, largest and the exact (lower) median by cumulative counts. The state is written once, as each step reads it."""
    state = cut_lineage(state)
    present = state.where("value is not null")
    totals = present.groupBy(*keys).agg(F.sum("n").alias("n_values"), F.count("*").alias("n_distinct"), F.min("value").alias("smallest"), F.max("value").alias("largest"))
    # cumulative counts in two steps: over cells of values first, then within the one cell that holds the median
    edges = present.groupBy(*keys).agg(F.percentile_approx("value", [i / 64 for i in range(1, 64)], 1000).alias("edges"))
    celled = present.join(edges, keys).withColumn("cell", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    cells = celled.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys).orderBy("cell")
    cells = cells.withColumns({"below": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "whole": F.sum("n").over(Window.partitionBy(*keys))})
    holder = cells.withColumn("rank", F.expr("(whole + 1) div 2")).where("below < rank and rank <= below + n").select(*keys, "cell", "below", "rank")
    inside = celled.join(holder, [*keys, "cell"])
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    medians = inside.withColumn("upto", F.col("below") + upto).where("upto >= rank and upto - n < rank").select(*keys, F.col("value").alias("median"))
    whole = records(state, keys).join(totals, keys, "left").join(medians, keys, "left")
    return whole.fillna(0, ["n_values", "n_distinct"])
