"""Totals over trailing days per entity, days without activity included.

Rows are summed per entity and day first (partial aggregation, so a hot entity is at most one row a day afterwards). Each entity meets the whole calendar from its first active
day to longest-1 days after its last, idle stretches included, and the totals are window sums over a fixed number of preceding rows. An entity costs a row per day of its calendar,
however many rows it has.

Nulls: rows with null entity or day are left out; a null or NaN amount adds nothing to total, count or average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(df: DataFrame, entity: Column, day: Column, amount: Column) -> DataFrame:
    """entity, day, n_rows, n_amounts, total."""
    rows = df.select(entity.alias("entity"), day.alias("day"), F.when(~F.isnan(amount.cast("double")), amount.cast("double")).alias("amount")).where("entity is not null and day is not null")
    return rows.groupBy("entity", "day").agg(F.count("*").alias("n_rows"), F.count("amount").alias("n_amounts"), F.sum("amount").alias("total"))


def densify(per_day: DataFrame, longest: int) -> DataFrame:
    """per_day with every day of each entity's calendar: from its first active day to longest - 1 days after its last. Days without activity have no rows, amounts or total.

    Each active day brings the idle days up to the next one, so the table of days is made in one pass over the daily sums."""
    order = Window.partitionBy("entity").orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(order), 1), F.date_add("day", longest - 1))
    spread = per_day.withColumn("until", until).select("*", F.explode(F.sequence("day", "until")).alias("at"))
    own = [F.when(F.col("at") == F.col("day"), F.col(c)).alias(c) for c in ("n_rows", "n_amounts", "total")]
    return spread.select("entity", F.col("at").alias("day"), *own)


def trailing(per_day: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """entity, day, n_rows of the day and for each period d: rows_d, amounts_d (how many amounts), total_d, average_d."""
    order = Window.partitionBy("entity").orderBy("day")
    columns = [F.col("entity"), F.col("day"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")]
    for d in periods:
        frame = order.rowsBetween(-(d - 1), 0)
        total, n = F.coalesce(F.sum("total").over(frame), F.lit(0.0)), F.coalesce(F.sum("n_amounts").over(frame), F.lit(0))
        columns += [F.coalesce(F.sum("n_rows").over(frame), F.lit(0)).alias(f"rows_{d}"), n.alias(f"amounts_{d}"), total.alias(f"total_{d}"), F.when(n > 0, total / n).alias(f"average_{d}")]
    return densify(per_day, max(periods)).select(*columns)
