"""Percentiles and distinct counts against exact values, with merges and deletions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyline.llm import distinct, quantiles


def test_codes_keep_order():
    values = np.array([-np.inf, -1e300, -5.5, -5.0, -1e-9, -0.0, 0.0, 1e-9, 1.0, 1.01, 99.99, 1e300, np.inf])
    codes = quantiles.encode(values)
    assert (np.diff(codes) >= 0).all() and quantiles.encode(np.array([-0.0])) == quantiles.encode(np.array([0.0]))
    for v in (-5.5, 1e-9, 1.01, 99.99, 1e300):
        assert abs(quantiles.decode(int(quantiles.encode(np.array([v]))[0])) - v) <= abs(v) * 2**-14


def rank_error(values, estimate, q):
    values, slack = np.sort(values), abs(estimate) * 2**-14
    low, high = np.searchsorted(values, estimate - slack, "left"), np.searchsorted(values, estimate + slack, "right")
    k = np.ceil(q * len(values))
    return max(0, low + 1 - k, k - high)


@pytest.mark.parametrize("kind", ["lognormal", "ties", "uniform", "signed"])
def test_rank_error_is_bounded(kind):
    rng = np.random.default_rng(1)
    values = {"lognormal": rng.lognormal(3, 2, 60_000), "ties": rng.choice([9.99, 10.0, 49.5, 1e6], 60_000), "uniform": rng.uniform(0, 1, 60_000), "signed": rng.normal(0, 50, 60_000)}[kind]
    sketch = np.zeros(quantiles.SIZE, np.int64)
    quantiles.add(sketch, quantiles.encode(values), np.ones(len(values), np.int64))
    asked = [0.01, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0]
    for q, found in zip(asked, quantiles.quantiles(sketch, asked)):
        assert rank_error(values, found, q) <= quantiles.EPSILON * len(values) + 1


def test_groups_merge_and_deletions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice([1, 2]), rng.choice([None, float("nan"), rng.gauss(10, 5)]), 1) for _ in range(4000)]
    gone = [("x", 1, 1e9, w) for w in (1, -1) for _ in range(500)]
    df = spark.createDataFrame(rows + gone, "g string, d int, v double, w int").repartition(5)
    daily = quantiles.sketches(df, F.col("v"), F.col("g"), F.col("d"), weight=F.col("w"))
    whole = quantiles.percentiles(quantiles.merge(daily, "g"), {"p50": 0.5, "p99": 0.99}).collect()
    assert len(whole) == 3
    for r in whole:
        own = np.array([v for g, _, v, _ in rows if g == r["g"] and v is not None and v == v])
        assert r["n"] == len(own)
        for q, c in ((0.5, "p50"), (0.99, "p99")):
            assert rank_error(own, r[c], q) <= quantiles.EPSILON * len(own) + 1
    assert quantiles.percentiles(quantiles.sketches(df.limit(0), F.col("v"), F.col("g")), {"p50": 0.5}).count() == 0


@pytest.mark.parametrize("n", [1, 50, 3000, 40_000, 700_000])
def test_distinct_counts(spark, n):
    df = spark.range(n).select((F.col("id") % 3).alias("g"), F.concat(F.lit("u"), "id").alias("u"))
    partial = distinct.bitmaps(df.union(df), F.col("u"), F.col("g"))
    for r in distinct.estimate(partial, "g").collect():
        exact = n // 3 + (r["g"] < n % 3)
        assert abs(r["n_distinct"] - exact) <= distinct.ERROR_BOUND * exact
    merged = distinct.estimate(distinct.merge(partial.withColumn("all", F.lit(1)), "all"), "all").first()
    assert abs(merged["n_distinct"] - n) <= distinct.ERROR_BOUND * n


def test_combinations_with_nulls(spark):
    rows = [("d1", "r1", "a"), ("d1", None, "a"), ("d2", "r1", "b"), ("d2", "r1", None), (None, "r1", "c"), ("d1", "r1", "a")]
    df = spark.createDataFrame(rows, "day string, region string, who string").withColumn("level", F.lit(99))
    partial = distinct.bitmaps(df, F.col("who"), F.col("day"), F.col("region"))
    got = {(r["day"], r["region"], r["day_total"], r["region_total"]): r["n_distinct"] for r in distinct.estimate(distinct.combinations(partial, "day", "region"), "day", "region", "day_total", "region_total").collect()}
    assert got[None, None, True, True] == 3 and got["d1", None, False, False] == 1 and got["d1", None, False, True] == 1
    assert got[None, "r1", True, False] == 3 and got[None, "r1", False, False] == 1 and len(got) == 10
    assert distinct.estimate(distinct.bitmaps(df.limit(0), F.col("who"), F.col("day")), "day").count() == 0


def test_listed_and_counted_forms_are_the_same():
    rng = np.random.default_rng(3)
    codes, weights = quantiles.encode(rng.lognormal(3, 2, 9000)), rng.choice([1, -1], 9000)
    whole = np.zeros(quantiles.SIZE, np.int64)
    quantiles.add(whole, codes, weights)
    parts = []
    for low, high in ((0, 10), (10, 3000), (3000, 9000), (9000, 9000)):
        part = quantiles.Summary()
        part.add(codes[low:high], weights[low:high])
        parts.append(part.pack())
    assert [p[:1] for p in parts] == [b"l", b"l", b"c", b"l"]
    merged = quantiles.Summary()
    for p in parts:
        merged.merge(p)
    assert (quantiles.unpack(merged.pack()) == whole).all() and (merged.sketch() == whole).all()


def tie_rank_error(values, estimate, q):
    """Without slack in the value."""
    values = np.sort(values)
    k = max(1, np.ceil(q * len(values)))
    return max(0, np.searchsorted(values, estimate, "left") + 1 - k, k - np.searchsorted(values, estimate, "right"))


def test_codes_decode_to_their_values():
    for v in (-np.inf, -99.0, -1e-300, 0.0, 5e-324, 0.1, 99.0, 99.00195, 1e300, np.inf):
        assert quantiles.decode(int(quantiles.encode(np.array([v]))[0])) == v


@pytest.mark.parametrize("kind", ["cents", "few", "many", "price points", "narrow"])
def test_rank_error_is_bounded_on_ties(kind):
    rng, n = np.random.default_rng(4), 60_000
    values = {
        "cents": np.round(rng.lognormal(3, 2, n), 2),
        "few": rng.choice(np.round(rng.uniform(1, 500, 300), 2), n),
        "many": rng.choice(np.round(rng.lognormal(3, 1, 5000), 2), n),
        "price points": np.where(rng.random(n) < 0.6, np.floor(rng.uniform(1, 200, n)) - 0.01, rng.lognormal(4, 1, n)),
        "narrow": 100 + rng.integers(0, 3000, n) / 1e10,
    }[kind]
    sketch = np.zeros(quantiles.SIZE, np.int64)
    quantiles.add(sketch, quantiles.encode(values), np.ones(n, np.int64))
    asked = [0.01, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0]
    for q, found in zip(asked, quantiles.quantiles(sketch, asked)):
        assert tie_rank_error(values, found, q) <= quantiles.EPSILON * n + 1


def test_tied_amounts_of_a_group(spark):
    rng = random.Random(5)
    rows = [("few", rng.choice([19.99, 49.5, 99.0])) for _ in range(20_000)] + [("many", rng.choice([99.0, round(rng.uniform(1, 200), 2)])) for _ in range(20_000)]
    sketched = quantiles.sketches(spark.createDataFrame(rows, "g string, v double").repartition(3), F.col("v"), F.col("g"))
    for r in quantiles.percentiles(sketched, {"p50": 0.5, "p90": 0.9}).collect():
        own = np.array([v for g, v in rows if g == r["g"]])
        for q, c in ((0.5, "p50"), (0.9, "p90")):
            error = tie_rank_error(own, r[c], q)
            assert r["n"] == len(own) and error <= (0 if r["g"] == "few" else quantiles.EPSILON * len(own) + 1)
