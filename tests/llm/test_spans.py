"""Shared spans against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from eddyline.llm import spans


def brute(docs, span):
    seen = defaultdict(set)
    for i, text in docs:
        if i is not None and text is not None:
            for p in range(len(text) - span + 1):
                seen[text[p : p + span]].add(i)
    out = set()
    for i, text in docs:
        if i is None or text is None:
            continue
        covered = np.zeros(len(text) + 1, bool)
        for p in range(len(text) - span + 1):
            if len(seen[text[p : p + span]]) > 1:
                covered[p : p + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int)])))
        out |= {(i, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])}
    return out


def corpus(rng, alphabet, n=40):
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9)))
    words = [word() for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    pool = [prose(rng.randrange(12, 60)) for _ in range(12)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            kind = rng.randrange(5)
            piece = rng.choice(pool)
            if kind == 0:
                parts.append(prose(rng.randrange(5, 80)))
            elif kind == 1:
                parts.append(piece)
            elif kind == 2:
                a = rng.randrange(len(piece))
                parts.append(piece[a : a + rng.randrange(30, 150)])
            elif kind == 3:
                k = rng.randrange(len(piece))
                parts.append(piece[:k] + rng.choice(alphabet) + piece[k + 1 :])
            else:
                parts.append(rng.choice(["-" * rng.randrange(50, 300), "ab" * rng.randrange(20, 120), " \r\n" * 60]))
        docs.append((i, rng.choice([" ", "", "\n"]).join(parts)))
    docs += [(100, docs[0][1]), (100, docs[0][1]), (101, ""), (102, None), (None, docs[1][1]), (103, docs[2][1] * 3), (104, docs[2][1][10:])]
    return docs


@pytest.mark.parametrize("seed,span,alphabet", [(0, 64, "abcdefgh"), (1, 100, "abcdefghijklmnop"), (2, 80, "aé漢😀𝔘b"), (3, 70, "ab"), (4, 250, "abcdefghijk")])
def test_matches_brute_force(spark, seed, span, alphabet):
    docs = corpus(random.Random(seed), alphabet)
    df = spark.createDataFrame(docs, "id long, text string").withColumn("pack", F.lit("clash")).withColumn("blob", F.lit(1))
    found = spans.shared_spans(df, F.col("id"), F.col("text"), span, pack_chars=3000, part_chars=[500, 10**6][seed % 2], block_chars=2000, partitions=3, buckets=5)
    got = [(r["doc_id"], r["start_pos"], r["end_pos"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, span)


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert spans.shared_spans(empty, F.col("id"), F.col("text")).count() == 0
    alone = spark.createDataFrame([(1, "x" * 999), (2, "short"), (1, "x" * 999)], "id long, text string")
    assert spans.shared_spans(alone, F.col("id"), F.col("text")).count() == 0
    with pytest.raises(ValueError, match="at least 64"):
        spans.shared_spans(empty, F.col("id"), F.col("text"), 63)


def test_ids_of_other_types(spark):
    docs = [(f"d{i}" if i is not None else None, t) for i, t in corpus(random.Random(8), "abcdefghij", 15)]
    df = spark.createDataFrame(docs, "id string, text string")
    got = [(r["doc_id"], r["start_pos"], r["end_pos"]) for r in spans.shared_spans(df, F.col("id"), F.col("text"), 90, partitions=2).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, 90)


def test_equal_digests_with_other_checks_are_told_apart():
    u8, u2 = (lambda *x: np.array(x, np.uint64)), (lambda *x: np.array(x, np.uint16))
    ids = np.array([1, 2])
    rows = list(spans._entries(7, u8(5, 5, 6), np.array([0, 1, 0]), ids, None, 1, u2(1, 2, 3))) + list(spans._entries(8, u8(5, 6), np.array([0, 0]), np.array([3]), None, 1, u2(2, 4)))
    told = spans._ask(pa.table({"pack": [r[1] for r in rows], "blob": [r[2] for r in rows]}))
    for pack in (7, 8):
        known = spans.Known(told.filter(pa.compute.equal(told.column("pack"), pack)))
        assert known.both((u8(5, 5, 6, 6), u2(1, 2, 3, 4))).tolist() == [False, True, False, False]


def test_a_bucket_is_asked_in_ranges():
    rng, rows = np.random.default_rng(5), []
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    for pack in range(6):
        docs = rng.integers(0, 4, 400)
        for checks in (None, rng.integers(0, 3, 400).astype(np.uint16)):
            digests = rng.choice(pool, 400) & (spans._PART if checks is None else ~np.uint64(0))
            rows += spans._entries(pack, digests, docs, np.arange(4) + 10 * pack, None, 1, checks)
    rows.append(spans._worth(3, 2, 77, np.array([1, 5]), 1))
    table = pa.table({"pack": [r[1] for r in rows], "blob": [r[2] for r in rows]})
    told = [sorted(zip(*(spans.answers(table, n).column(c).to_pylist() for c in ("pack", "blob")))) for n in (10**6, 100, 7)]
    assert told[0] == told[1] == told[2] and len(told[0]) == 13


def test_any_span_holds_a_whole_chunk():
    rng = random.Random(9)
    core = "".join(rng.choice("abcdefghij ") for _ in range(250))
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    block = spans.Block([texts[2 * i] + core + texts[2 * i + 1] for i in range(20)], 250)
    digests, whole = block.chunks()
    sets = [set(digests[block.cut_doc[whole] == i].tolist()) for i in range(20)]
    assert set.intersection(*sets)


def test_packs_stay_partitioned(spark):
    rows = spark.range(200).select("id", F.repeat(F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.md5(F.col("id").cast("string"))), 4).alias("text"))
    packed = spans.packs(rows, F.col("id"), F.col("text"), 250, 5000, 10**6, 3)
    plan = packed.groupBy("pack").agg(F.first("blob"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
