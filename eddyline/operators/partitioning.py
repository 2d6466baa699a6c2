"""Placing rows: hash partitions by keys, and broadcasting only what is known to be small.

Results never depend on it; equal keys are always in one partition. Null keys are equal to each other. No key at all means every partition needs the whole table: broadcast().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_id(keys: list[str], n: int) -> Column:
    """The partition in which repartition() puts a row with these keys."""
    return F.pmod(F.hash(*keys), F.lit(n))


def repartition(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """n partitions by the hash of the keys, empty ones included."""
    return df.repartition(n, *keys) if keys else broadcast(df)


def salted(df: DataFrame, keys: list[str], salts: int, spread: Column) -> DataFrame:
    """The rows with a column salt by which a hot key is split; aggregate by keys and salt first, then by keys."""
    return df.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).repartition(*keys, "salt")


def size_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """A broadcast hint if the estimated size is at most most_bytes; else the table as it is, which leaves the join to shuffle both sides."""
    return F.broadcast(df) if size_bytes(df) <= most_bytes else df
