"""The general operators against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eddyline.functions import norm_id
from eddyline.operators import gap_tree, late, orphans, repeats, rolling


def sessions(times, gap):
    out = []
    for t in sorted(set(times)):
        if out and t - out[-1][1] <= gap:
            out[-1][1] = t
        else:
            out.append([t, t])
    return [tuple(s) for s in out]


@pytest.mark.parametrize("seed", range(4))
def test_gap_tree_matches_sessions_for_any_threshold(spark, seed):
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(-3000, 3000)) for _ in range(300)] + [(f"u{rng.randrange(9)}", rng.randrange(0, 2000, 5)) for _ in range(200)]
    rows += rows[:40] + [(None, 5), ("u1", None), ("one", 7)]
    df = spark.createDataFrame(rows, "who string, height_us long").withColumn("cell", F.lit("clash"))
    tree = gap_tree.gap_tree(df, F.col("who"), F.col("height_us"), cell_us=[40, 500, 10**6, 7][seed], hot_rows=[100, 5, 10**6, 20][seed]).persist()
    by_user = defaultdict(list)
    for who, t in rows:
        if who is not None and t is not None:
            by_user[who].append(t)
    for gap in (0, 1, 5, 17, 60, 10_000):
        got = sorted((r["entity"], r["start_us"], r["end_us"]) for r in gap_tree.cut(tree, gap).collect())
        assert got == sorted((u, *s) for u, ts in by_user.items() for s in sessions(ts, gap))
    whole = gap_tree.cut(tree, 10**9)
    assert {r["entity"]: r["n_events"] for r in whole.collect()} == {u: len(set(ts)) for u, ts in by_user.items()}


def segments(rows, entity="a"):
    """Leaves (cell, time) as the walk takes them."""
    names = ["entity", "cell", "start_us", "end_us", "n_events", "height_us", "state"]
    return pa.table({n: pa.array([(entity, c, t, t, 1, 0, 1)[i] for c, t in rows], [pa.string(), *[pa.int64()] * 5, pa.int32()][i]) for i, n in enumerate(names)})


def walked(rows, last_step, most, size=3):
    parts = list(gap_tree.walk(iter(rows.to_batches(max_chunksize=size)), last_step, most))
    return [tuple(r.values()) for part in parts for r in part.to_pylist()]


def test_nodes_of_ties():
    gaps, times = [3, 5, 3, 3, 5, 1], [0]
    for g in gaps:
        times.append(times[-1] + g)
    closed, rest = gap_tree.tree(segments([(0, t) for t in times]), last_step=True)
    inner = sorted((r["start_us"], r["end_us"], r["height_us"], r["parent_us"]) for r in closed.to_pylist() if r["height_us"])
    assert inner == [(0, 3, 3, 5), (0, 20, 5, None), (8, 14, 3, 5), (19, 20, 1, 5)] and rest.num_rows == 0 and closed.num_rows == 4 + 7


@pytest.mark.parametrize("seed,most", [(0, 4), (1, 7), (2, 50), (3, 4), (4, 3)])
def test_long_groups_are_contracted(seed, most):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(4000), 300)) if seed % 2 else sorted({k * 10 for k in range(200)} | {rng.randrange(2000) for _ in range(40)})
    first = walked(segments([(t // 900, t) for t in times]), False, most)
    rest = sorted((r for r in first if r[7] != 0), key=lambda r: r[2:4])
    assert len(rest) < len(times) / 2
    table = pa.table({n: pa.array([r[i] for r in rest], pa.string() if n == "entity" else pa.int32() if n == "state" else pa.int64()) for i, n in enumerate(gap_tree.NAMES) if n != "parent_us"})
    table = table.set_column(1, "cell", pa.array([0] * len(rest), pa.int64()))
    nodes = [r for r in first if r[7] == 0] + walked(table, True, most)
    for gap in (0, 1, 3, 9, 10, 11, 30, 5000):
        got = sorted((r[2], r[3]) for r in nodes if r[5] <= gap and (r[6] is None or r[6] > gap))
        assert got == sessions(times, gap)


def test_even_gaps_contract():
    closed, rest = gap_tree.tree(segments([(0, 10 * k) for k in range(1000)]), last_step=False)
    assert rest.num_rows == 3 and rest.column("n_events").to_pylist() == [1, 998, 1]


@pytest.mark.parametrize("shape", ["falling", "rising", "saw"])
def test_gaps_that_are_far_from_their_larger_ones(shape):
    n = 20_000
    gaps = {"falling": range(n, 0, -1), "rising": range(1, n + 1), "saw": [k % 100 * 1000 + k // 100 for k in range(1, n)]}[shape]
    times = [0]
    for g in gaps:
        times.append(times[-1] + g)
    rows = walked(segments([(0, t) for t in times]), True, 10**6, 10**5)
    for gap in (0, 1, 999, 5000, 10**6):
        assert sorted((r[2], r[3]) for r in rows if r[5] <= gap and (r[6] is None or r[6] > gap)) == sessions(times, gap)


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_session_events_count_once(spark, hot_rows):
    rows = [("a", 0, 1), ("a", 0, 1), ("a", 10, 2), ("a", 10, None), ("a", 20, 3), ("a", 500, 4), ("a", 600, None), (None, 0, 3)]
    df = spark.createDataFrame(rows, "u string, t long, id int")
    cut = gap_tree.cut(gap_tree.gap_tree(df, F.col("u"), F.col("t"), F.col("id"), 15, hot_rows), 10)
    assert sorted((r["start_us"], r["end_us"], r["n_events"]) for r in cut.collect()) == [(0, 20, 3), (500, 500, 1), (600, 600, 0)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "u string, t long, id int, msg_offset long, arrival_us long, src string, batch_id long, us long, d date, amount double")
    tree = gap_tree.gap_tree(df, F.col("u"), F.col("t"))
    assert tree.count() == 0 and gap_tree.gap_tree(df, F.col("u"), F.col("t"), F.col("id")).count() == 0
    assert repeats.repeats(df.withColumn("id", F.col("u"))).count() == 0
    assert rolling.trailing(rolling.daily(df, F.col("u"), F.col("d"), F.col("amount"))).count() == 0
    assert late.judged(df).count() == 0 and late.derive(late.multiset(df, ["u"], "amount"), ["u"]).count() == 0
    refs = orphans.references(df, F.col("u"), F.col("u"), F.col("t"))
    assert orphans.missing(refs, df, F.col("u")).count() == 0


def test_norm_id(spark):
    df = spark.createDataFrame([(" A-1 ",), ("a-1",), ("  ",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(norm_id("x")).collect()] == ["a-1", "a-1", None, None, None]


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    rng = random.Random(seed)
    day = 86_400_000_000
    rows = [(rng.choice("xy"), rng.choice([None, "hot", *(f"i{k}" for k in range(400))]), rng.randrange(10**6), rng.choice([None, *(k * day // 2 for k in range(12))])) for _ in range(900)]
    df = spark.createDataFrame(rows, "src string, id string, msg_offset long, arrival_us long").withColumn("bucket", F.lit(1)).withColumn("h", F.lit(2))
    got = Counter({(r["src"], r["id"], r["msg_offset"]): r["surplus"] for r in repeats.repeats(df).collect()})
    groups = defaultdict(list)
    for src, i, o, _ in rows:
        if i is not None:
            groups[src, i].append(o)
    want = Counter((src, i, o) for (src, i), offsets in groups.items() for o in sorted(offsets)[1:])
    assert got == want


def test_bloom_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (3, 2000, 100_000):
        inside, outside = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, 50_000).astype(np.uint64)
        bloom = repeats.Bloom(n)
        bloom.add(inside)
        assert bloom.may_hold(inside).all() and bloom.may_hold(outside).mean() < 0.005


def test_sliced_blooms():
    rng = np.random.default_rng(2)
    blooms, inside, false = repeats.SlicedBlooms(500), [], 0
    for k in range(150):
        hashes = rng.integers(0, 2**63, 500).astype(np.uint64)
        again = inside[k // 2][:20] if k else hashes[:0]
        index, match = blooms.screen(np.concatenate([hashes, again]), k)
        pairs = set(zip(index.tolist(), match.tolist()))
        assert all((500 + i, k // 2) in pairs for i in range(len(again))) and all(m < k for _, m in pairs)
        false += sum(i < 500 for i, _ in pairs)
        inside.append(hashes)
    assert false < 0.003 * 500 * 150 * 75


def test_first_copies(spark):
    rows = [("A", 5, 1.0), (" a", 3, 2.0), (None, 1, 3.0), (None, 2, 3.0), ("b", None, 4.0), ("b", 9, 5.0)]
    df = spark.createDataFrame(rows, "id string, msg_offset long, row double")
    got = sorted((r["msg_offset"], r["row"]) for r in repeats.first_copies(df, norm_id("id")).collect())
    assert got == [(1, 3.0), (2, 3.0), (3, 2.0), (9, 5.0)]


def test_rolling(spark):
    rng = random.Random(3)
    base = dt.date(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *(base + dt.timedelta(days=k) for k in (0, 1, 5, 20, 21, 100, 129, 130))]), rng.choice([None, float("nan"), -1.0, 2.5, 2.5])) for _ in range(120)]
    rows.append(("old", dt.date(1970, 1, 1), 1.0))
    rows.append(("old", base, 2.0))
    df = spark.createDataFrame(rows, "entity string, day date, total double")
    got = {(r["entity"], r["day"]): r.asDict() for r in rolling.trailing(rolling.daily(df, F.col("entity"), F.col("day"), F.col("total")), (7, 30)).collect()}
    want = set()
    for u in {u for u, day, _ in rows if u and day}:
        days = [day for v, day, _ in rows if v == u and day]
        want |= {(u, min(days) + dt.timedelta(days=k)) for k in range((max(days) - min(days)).days + 30)}
    assert set(got) == want
    active = {(v, t) for v, t, _ in rows}
    for (u, day), row in got.items():
        if u == "old" and not any((u, day - dt.timedelta(days=k)) in active for k in range(30)):
            assert (row["n_rows"], row["rows_30"], row["total_30"], row["average_30"]) == (0, 0, 0.0, None)
            continue
        for d in (7, 30):
            inside = [x for v, t, x in rows if v == u and t and 0 <= (day - t).days < d]
            values = [x for x in inside if x is not None and x == x]
            assert row[f"rows_{d}"] == len(inside) and row[f"total_{d}"] == pytest.approx(sum(values))
            assert row[f"average_{d}"] == (pytest.approx(sum(values) / len(values)) if values else None)


def test_orphans(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    orders = spark.createDataFrame([("o1", "p1", at(5)), ("o1", "p1", at(5)), ("o2", "p1", at(1)), ("o3", "p2", at(9)), ("o4", None, at(9)), ("o5", "p3", at(9)), ("o6", "p1", None), (None, "p9", at(9)), ("o7", "p2", at(6))], "record_id string, ref_id string, at timestamp")
    feed = spark.createDataFrame([("p1", at(2), "upsert"), ("p2", at(1), "upsert"), ("p2", at(6), "delete"), ("p2", at(6), "delete"), ("p3", at(1), "delete"), ("p3", at(9), "upsert")], "ref_id string, at timestamp, change_op string")
    deliveries = spark.createDataFrame([("d1", "o1", at(6)), ("d2", "o9", at(6)), ("d2", "o9", at(6)), ("d3", "o3", at(9)), ("d4", None, at(9)), (None, "o9", at(9))], "record_id string, ref_id string, at timestamp")
    refs = lambda df: orphans.references(df, F.col("record_id"), F.col("ref_id"), F.col("at"))
    alive = orphans.lifetimes(feed, F.col("ref_id"), F.col("at"), F.col("change_op") != "delete")
    edges = [
        orphans.Edge("deliveries", "orders", refs(deliveries), orphans.missing(refs(deliveries), orders, F.col("record_id"))),
        orphans.Edge("orders", "feed", refs(orders), orphans.missing_then(refs(orders), alive)),
    ]
    got = sorted((r["src_table"], r["record_id"], r["ref_id"], r["kind"], r["depth"]) for r in orphans.cascade(edges).collect())
    assert got == [("deliveries", "d2", "o9", "direct", 0), ("deliveries", "d3", "o3", "inherited", 1), ("orders", "o2", "p1", "direct", 0), ("orders", "o3", "p2", "direct", 0), ("orders", "o7", "p2", "direct", 0)]


def _edge(spark, child, parent, rows, lost):
    refs, bad = (spark.createDataFrame([(*r, None) for r in x], "record_id string, ref_id string, at timestamp") for x in (rows, lost))
    return orphans.Edge(child, parent, refs, bad)


def _orphans(edges):
    return sorted((r["src_table"], r["parent"], r["record_id"], r["ref_id"], r["kind"], r["depth"]) for r in orphans.cascade(edges).collect())


def test_orphans_of_a_table_with_two_foreign_keys(spark):
    lines = [_edge(spark, "lines", "orders", [("l1", "1"), ("l2", "9"), ("l3", "2")], [("l2", "9")]), _edge(spark, "lines", "parts", [("l1", "1"), ("l2", "1"), ("l3", "9")], [("l3", "9")])]
    above = [_edge(spark, "orders", "users", [("1", "u1"), ("2", "u2")], [("1", "u1")]), _edge(spark, "parts", "makers", [("1", "m1")], [("1", "m1")])]
    want = [
        *(("lines", "orders", r, t, k, d) for r, t, k, d in (("l1", "1", "inherited", 1), ("l2", "9", "direct", 0))),
        *(("lines", "parts", r, t, k, d) for r, t, k, d in (("l1", "1", "inherited", 1), ("l2", "1", "inherited", 1), ("l3", "9", "direct", 0))),
        ("orders", "users", "1", "u1", "direct", 0),
        ("parts", "makers", "1", "m1", "direct", 0),
    ]
    assert _orphans(lines + above) == _orphans(above + lines[::-1]) == want


def test_orphans_of_two_keys_to_the_same_table(spark):
    edges = [_edge(spark, "orders", "places", [("o1", "a"), ("o2", "b")], [("o1", "a")]), _edge(spark, "orders", "places", [("o1", "a"), ("o2", "c")], [("o1", "a"), ("o2", "c")])]
    assert _orphans(edges) == [("orders", "places", "o1", "a", "direct", 0), ("orders", "places", "o2", "c", "direct", 0)]


def test_orphans_in_cycles(spark):
    chain = [(f"e{k}", f"e{k - 1}") for k in range(1, 6)] + [("x", "y"), ("y", "x")]
    want = [("staff", "staff", f"e{k}", f"e{k - 1}", "inherited" if k > 1 else "direct", k - 1) for k in range(1, 6)]
    assert _orphans([_edge(spark, "staff", "staff", chain, chain[:1])]) == want
    a = _edge(spark, "a", "b", [("a1", "b0"), ("a2", "b1"), ("a3", "b2")], [("a1", "b0")])
    b = _edge(spark, "b", "a", [("b1", "a1"), ("b2", "a2"), ("b3", "a9")], [("b3", "a9")])
    assert [(r[2], r[5]) for r in _orphans([a, b])] == [("a1", 0), ("a2", 2), ("a3", 4), ("b1", 1), ("b2", 3), ("b3", 0)]


def test_late(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), k, k // 7 * 300, rng.choice([None, k * 30 + rng.randrange(-900, 60), 0])) for k in range(400)]
    df = spark.createDataFrame(rows, "src string, msg_offset long, batch_id long, us long").withColumn("late", F.lit("clash")).withColumn("block", F.lit(0))
    got = {(r["src"], r["msg_offset"]): r["late"] for r in late.judged(df, 100, 60).collect()}
    for src, offset, batch, us in rows:
        if us is not None:
            earlier = [t for s, _, b, t in rows if s == src and b < batch and t is not None]
            assert got.pop((src, offset)) == bool(earlier and us - us % 60 + 60 <= max(earlier) - 100)
    assert not got


def test_multiset_state(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *(float(x) for x in range(40)), 3.0, 3.0])) for _ in range(1500)] + [(9, None)]
    first = late.multiset(spark.createDataFrame(rows[:700], "k int, v double"), ["k"], "v")
    second = late.multiset(spark.createDataFrame(rows[700:] + [(1, 77.0)], "k int, v double"), ["k"], "v")
    undone = late.multiset(spark.createDataFrame([(1, 77.0)], "k int, v double"), ["k"], "v", F.lit(-1))
    state = late.merge(late.merge(first, second, ["k"]), undone, ["k"])
    got = {r["k"]: r for r in late.derive(state, ["k"]).where("k is not null").collect()}
    for k in (1, 2, 9):
        own = [v for key, v in rows if key == k]
        values = sorted(v for v in own if v is not None)
        r = got[k]
        assert (r["n_records"], r["n_values"], r["n_distinct"]) == (len(own), len(values), len(set(values)))
        if values:
            assert (r["smallest"], r["largest"], r["median"]) == (values[0], values[-1], values[(len(values) + 1) // 2 - 1])
