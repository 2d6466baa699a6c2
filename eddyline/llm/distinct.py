"""Distinct counts by multiresolution bitmaps.

A hash (60 bits of MD5) has level i with probability 2^-(i+1); each level is a small bitmap, addressed by other bits of the hash. Bitmaps merge by OR, here as rows (group, level, word, bits)
under bit_or, so partial bitmaps are combined before every shuffle and any combination of groups comes from the finest partial results. The estimate takes the levels from the
first that is not saturated and scales by the share of hashes they hold. With 8,192 bits a level the standard error is about 1.2 %; ERROR_BOUND is four of it.

Null identifiers are left out; null group values are a group of their own. An empty table has no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, LEVELS, SATURATED, ERROR_BOUND = 8192, 44, 0.7, 0.05


def bitmaps(df: DataFrame, item: Column, *groups: Column) -> DataFrame:
    """The partial result: groups, level, word, bits."""
    h = F.conv(F.substring(F.md5(item.cast("string")), 1, 15), 16, 10).cast("long")  # 60 bits
    rows = df.where(item.isNotNull()).select(*groups, h.alias("h"))
    high = F.shiftright("h", 16)  # 44 bits decide the level: their leading zeros
    level = F.when(high == 0, LEVELS - 1).otherwise(LEVELS - F.length(F.bin(high)))
    place = F.col("h").bitwiseAND(F.lit(BITS - 1))
    names = [c for c in rows.columns if c != "h"]
    marked = rows.select(*names, level.cast("int").alias("level"), (place / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    return marked.groupBy(*names, "level", "word").agg(F.bit_or("bit").alias("bits"))


def merge(partial: DataFrame, *groups: str | Column) -> DataFrame:
    """Bitmaps of the coarser groups, by OR."""
    return partial.groupBy(*groups, "level", "word").agg(F.bit_or("bits").alias("bits"))


def combinations(partial: DataFrame, first: str, second: str) -> DataFrame:
    """Bitmaps for both groups, each alone and the whole; {name}_total tells a total from a null group."""
    flags = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (False, True) for b in (False, True)])).alias("t")
    spread = partial.select("*", flags)
    keep = [F.when(~F.col(f"t.{flag}"), F.col(name)).alias(name) for name, flag in ((first, "a"), (second, "b"))]
    spread = spread.select(*keep, F.col("t.a").alias(f"{first}_total"), F.col("t.b").alias(f"{second}_total"), "level", "word", "bits")
    return merge(spread, first, second, f"{first}_total", f"{second}_total")


def estimate(merged: DataFrame, *groups: str) -> DataFrame:
    """groups, n_distinct (rounded) and the error bound."""
    per_level = merged.groupBy(*groups, "level").agg(F.sum(F.bit_count("bits")).alias("z"))
    per_group = per_level.groupBy(*groups).agg(F.coalesce(F.max(F.when(F.col("z") > SATURATED * BITS, F.col("level"))) + 1, F.lit(0)).alias("base"), F.collect_list(F.struct("level", "z")).alias("levels"))
    linear = F.aggregate(
        F.filter("levels", lambda x: x["level"] >= F.col("base")), F.lit(0.0), lambda total, x: total + BITS * F.log(BITS / F.greatest(F.lit(0.5), BITS - x["z"]))
    )
    return per_group.select(*groups, F.round(F.pow(F.lit(2.0), F.col("base")) * linear).cast("long").alias("n_distinct"), F.lit(ERROR_BOUND).alias("error_bound"))
