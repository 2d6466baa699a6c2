"""Small column helpers that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def norm_id(column: str | Column) -> Column:
    """An identifier without surrounding spaces, in lower case; a blank one is null."""
    trimmed = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.when(trimmed != "", trimmed)


def floor_to(us: Column, width: int) -> Column:
    """The start of the width-wide cell that holds the integer, also below zero; no floating point."""
    return us - F.pmod(us, F.lit(width))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table of that name in the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
