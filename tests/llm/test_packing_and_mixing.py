"""Containers and mixes: every piece once, capacities and caps kept, little space left, shares reached."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eddyline.llm import mixing, packing, tokens


@pytest.mark.parametrize("seed,capacity", [(0, 100), (1, 37), (2, 1), (3, 4096)])
def test_patterns_use_up_the_histogram(seed, capacity):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, capacity + 1): rng.choice([1, 3, 10**6]) for _ in range(40)}
    patterns = packing.shortest_pack_first(histogram, capacity)
    used = Counter()
    for count, items in patterns:
        assert count > 0 and sum(size * each for size, each in items) <= capacity
        for size, each in items:
            used[size] += count * each
    assert used == Counter(histogram)
    table = packing.places(patterns)
    assert (table[:, 2] > 0).all()


def test_mixed_lengths_fill_well():
    rng = random.Random(4)
    histogram = Counter(min(4096, int(rng.lognormvariate(6.6, 0.7)) + 1) for _ in range(20_000))
    patterns = packing.shortest_pack_first(histogram, 4096)
    total = sum(k * n for k, n in histogram.items())
    assert sum(c for c, _ in patterns) <= 1.01 * -(-total // 4096)


def test_containers(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([None, 0, 7, 7, 7, 50, rng.randrange(1, 400)])) for i in range(600)] + [(7000, 7), (7000, 7)]
    df = spark.createDataFrame(sizes, "id long, n long").withColumn("length", F.lit(1)).withColumn("salt", F.lit("x"))
    rows = packing.containers(packing.assign(packing.pieces(df, F.col("id"), F.col("n"), 100), 100, salts=3), 100).collect()
    seen = Counter()
    for r in rows:
        assert r["n_tokens"] <= 100 and r["fill"] == pytest.approx(r["n_tokens"] / 100) and r["n_items"] == len(r["contents"])
        at = 0
        for c in r["contents"]:
            assert c["offset"] == at
            at += c["length"]
            seen[c["item_id"], c["start"], c["length"]] += 1
        assert at == r["n_tokens"]
    want = Counter()
    for i, n in sizes:
        for start in range(0, n or 0, 100):
            want[i, start, min(100, n - start)] += 1
    assert seen == want and len({r["container_id"] for r in rows}) == len(rows)
    total = sum(n or 0 for _, n in sizes)
    assert len(rows) <= -(-total // 100) + 3


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_tokens long, weight double")
    assert packing.containers(packing.assign(packing.pieces(df, F.col("doc_id"), F.col("n_tokens"), 10), 10), 10).count() == 0
    planned = mixing.plan(df, mixing.targets(spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")))
    assert mixing.select(df, planned).count() == 0 and mixing.shares(mixing.select(df, planned), planned).count() == 1


def test_token_counts(spark):
    coder = tokens.encoder(tokens.DEFAULT_VOCABULARY)
    texts = ["", None, "The proof follows \\cite{x}.", "ä漢😀\r\n", " " * 5000, "a" * 3000, *(a + s * 12_000 + b for s in (" ", "\n\t", "\u3000", "\x1c ") for a in ("", "x'") for b in ("", "'s b", "1"))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tokens.token_count("t")).collect()]
    assert got == [None if t is None else len(coder.encode_ordinary(t)) for t in texts]


def test_white_space_too_long_for_the_pattern(spark):
    coder = tokens.encoder(tokens.DEFAULT_VOCABULARY)
    runs = [tokens.length(coder, "a" + " " * n + "b") for n in (15_000, 1_500_000)]
    assert runs[0] == len(coder.encode_ordinary("a" + " " * 15_000 + "b")) and 90 < runs[1] / runs[0] < 110


def mix(spark, docs, goals):
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, weight double").withColumn("cell", F.lit("clash")).withColumn("rest", F.lit(0))
    planned = mixing.plan(sized, mixing.targets(spark.createDataFrame(goals, "source string, target_share double, max_repeats int").withColumn("available", F.lit("clash"))))
    chosen = mixing.select(sized, planned)
    return {r["doc_id"]: (r["source"], r["n_tokens"], r["repeats"]) for r in chosen.collect()}, {r["source"]: r for r in mixing.shares(chosen, planned).collect()}


def test_mix_reaches_shares(spark):
    rng = random.Random(6)
    docs = [(i, s, rng.randrange(1, 900), rng.uniform(0.1, 1)) for i, s in enumerate(rng.choices(["big", "mid", "small", "other"], [60, 30, 3, 7], k=6000))]
    chosen, shares = mix(spark, docs, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 8), ("absent", 0.1, 3), ("small", 0.0, 8)])
    tokens_of = defaultdict(int)
    caps = {"big": 1, "mid": 2, "small": 8}
    for source, n, repeats in chosen.values():
        assert 1 <= repeats <= caps[source]
        tokens_of[source] += n * repeats
    have = defaultdict(int)
    for _, s, n, _ in docs:
        have[s] += n
    whole = min(caps[s] * have[s] / share for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)))
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        assert abs(tokens_of[s] - share * whole) <= 900 and shares[s]["tokens"] == tokens_of[s]
        assert {r for x, _, r in chosen.values() if x == s} <= {shares[s]["epochs"], shares[s]["epochs"] + 1}
    assert shares["absent"]["tokens"] == 0 and sum(r["actual_share"] for r in shares.values()) == pytest.approx(1)


def test_weights_matter(spark):
    docs = [(i, "a", 10, 1.0 if i % 2 else 0.1) for i in range(4000)] + [(10_000 + i, "b", 10, 1.0) for i in range(400)]
    chosen, _ = mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    a = [i for i, (s, _, _) in chosen.items() if s == "a"]
    assert len(a) == 400 and sum(i % 2 for i in a) / len(a) > 0.85


def test_low_weights_spread_over_cells(spark):
    docs = [(i, "a", 10, [0.1, 0.5, None, float("nan"), 0.0][i % 5]) for i in range(5000)]
    chosen, shares = mix(spark, docs, [("a", 1.0, 1)])
    assert len(chosen) == 5000 and shares["a"]["tokens"] == 50_000
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, weight double")
    planned = mixing.plan(sized, mixing.targets(spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")), 20_005)
    assert mixing.select(sized, planned).count() in (2000, 2001)


def test_odd_targets(spark):
    docs = [(1, "a", 10, 1.0), (2, "b", 10, 1.0)]
    chosen, shares = mix(spark, docs, [("a", None, 2), ("b", 0.5, None), (None, 0.5, 1), ("c", float("nan"), 1), ("d", -1.0, 1)])
    assert chosen == {2: ("b", 10, 1)} and set(shares) == {"a", "b", "c", "d"}
