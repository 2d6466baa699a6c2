"""State between micro-batches: repeats and late records."""

import random

import pytest
from pyspark.sql import functions as F

from eddyline.streaming.stores import PeriodStore, RepeatStore, batches

DAY = 86_400_000_000


@pytest.mark.parametrize("every", [2, 100])
def test_repeat_store(spark, tmp_path, every):
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", *(f"i{k}" for k in range(150))]), k, k * DAY // 40, k // 60, k % 3) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, msg_offset long, arrival_us long, batch int, bucket int")
    store = RepeatStore(spark, str(tmp_path / "s"), shards=3, compact_every=every)
    kept = []
    for k, part in batches(df, "batch"):
        for _ in range(2 if k == 2 else 1):  # a replayed batch gives the same
            again = sorted(r["msg_offset"] for r in store.feed(part, k).collect())
        kept += again
    seen, want = set(), []
    for i, offset, *_ in rows:
        if i is None or i not in seen:
            want.append(offset)
        seen.add(i)
    assert sorted(kept) == want
    if every == 2:
        assert store.ids.numbers("upto") == [1, 3] and store.ids.numbers("batch") == [2, 3, 4] and store.filters.before(5).count() <= 3 * 9


def test_identifiers_past_the_retention_pass_again(spark, tmp_path):
    store = RepeatStore(spark, str(tmp_path / "s"), shards=2, compact_every=1, retention_us=3 * DAY)
    feed = lambda k, *rows: sorted(r["id"] for r in store.feed(spark.createDataFrame(list(rows), "id string, msg_offset long, arrival_us long"), k).collect())
    assert feed(0, ("a", 0, 0), ("b", 1, DAY), ("b", 2, DAY)) == ["a", "b"]
    assert feed(1, ("a", 3, 3 * DAY), ("c", 4, 3 * DAY)) == ["c"]
    assert feed(2, ("a", 5, 4 * DAY), ("b", 6, 4 * DAY)) == ["a"]


def test_empty_batches(spark, tmp_path):
    none = spark.createDataFrame([], "id string, msg_offset long, arrival_us long, us long, value double")
    repeats, periods = RepeatStore(spark, str(tmp_path / "r"), shards=2, compact_every=1), PeriodStore(spark, str(tmp_path / "p"), compact_every=1)
    for k in range(2):
        assert repeats.feed(none, k).count() == 0 and [df.count() for df in periods.feed(none, k)] == [0, 0] and periods.aggregates(k).count() == 0


@pytest.mark.parametrize("every", [1, 3, 100])
def test_period_store(spark, tmp_path, every):
    rng = random.Random(2)
    rows = [(rng.choice([None, max(0, 40 * k + rng.randrange(-2500, 100))]), rng.choice([None, 1.0, 2.0, 2.0, 7.0]), k // 50) for k in range(200)]
    df = spark.createDataFrame(rows, "us long, value double, batch int")
    store, late, latest = PeriodStore(spark, str(tmp_path / "p"), lateness_us=1000, period_us=600, compact_every=every), 0, {}
    for k, part in batches(df, "batch"):
        changed, dropped = store.feed(part.drop("batch"), k)
        late += dropped.count()
        latest |= {r["period_us"]: (r["n_records"], r["n_values"], r["n_distinct"], r["median"]) for r in changed.collect()}
    want, dropped = {}, 0
    for k in range(4):
        earlier = [u for u, _, b in rows if u is not None and b < k]
        for us, value, b in rows:
            if b == k and us is not None:
                if earlier and us - us % 600 + 600 <= max(earlier) - 1000:
                    dropped += 1
                else:
                    want.setdefault(us - us % 600, []).append(value)
    stats = {}
    for period, values in want.items():
        real = sorted(v for v in values if v is not None)
        stats[period] = (len(values), len(real), len(set(real)), real[(len(real) + 1) // 2 - 1] if real else None)
    assert late == dropped and dropped > 0 and latest == stats
    after = {r["period_us"]: (r["n_records"], r["n_values"], r["n_distinct"], r["median"]) for r in store.aggregates(3).collect()}
    assert after == stats and (every > 4 or store.closed.before(4).count() > 0)
    back = df.where("us = us").limit(0).withColumn("weight", F.lit(-1))
    assert store.feed(back.drop("batch"), 9)[0].count() == 0
