"""Filling containers of fixed capacity with items of varying length, shortest pack first over the length histogram.

Only the histogram (one row per length, so at most capacity rows) reaches the driver. The lengths are placed longest first, each into the pack with the most space
left; packs with the same contents are one pattern with a count. The patterns are joined back by rank: the k-th item of a length takes the k-th place that the
patterns have for that length. Ranks are found per (length, salt) with offsets over the salts, so a length that a third of all items share is split.

Items longer than the capacity are split into full pieces and a rest; no other item is split. Items without length (null or 0) are left out. An empty table gives no
containers. Repeated rows are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count, [(length, how many of it)]) that use up the histogram."""
    by_space: dict[int, list[tuple[int, tuple | None]]] = {}
    spaces: list[int] = []  # a heap of the spaces left, most first
    import heapq

    def put(space: int, count: int, chain: tuple | None) -> None:
        if space not in by_space:
            by_space[space] = []
            heapq.heappush(spaces, -space)
        by_space[space].append((count, chain))

    done: list[tuple[int, tuple | None]] = []
    for size in sorted(histogram, reverse=True):
        left, waiting = histogram[size], []
        while left:
            space = -spaces[0] if spaces else -1
            if space < size:  # no open pack can take it
                take = left // max(1, capacity // size)  # packs full of this length alone
                if take:
                    each = capacity // size
                    waiting.append((capacity - each * size, take, (size, each, None)))
                    left -= take * each
                else:
                    waiting.append((capacity - left * size, 1, (size, left, None)))
                    left = 0
                continue
            count, chain = by_space[space].pop()
            if not by_space[space]:
                del by_space[space]
                heapq.heappop(spaces)
            used = min(count, left)
            if used < count:
                put(space, count - used, chain)
            left -= used
            if chain and chain[0] == size:
                put(space - size, used, (size, chain[1] + 1, chain[2]))
            else:
                put(space - size, used, (size, 1, chain))
        for space, count, chain in waiting:
            put(space, count, chain)
    for packs in by_space.values():
        done += packs
    patterns = []
    for count, chain in done:
        items = []
        while chain:
            items.append((chain[0], chain[1]))
            chain = chain[2]
        patterns.append((count, items[::-1]))
    return patterns


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, how many per container, first container, offset in the container), sorted by length and first rank."""
    rows, taken, container = [], {}, 0
    for count, items in patterns:
        offset = 0
        for size, each in items:
            rows.append((size, taken.get(size, 0), each, container, offset))
            taken[size] = taken.get(size, 0) + count * each
            offset += size * each
        container += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(items: DataFrame, item_id: Column, size: Column, capacity: int) -> DataFrame:
    """item_id, piece, start, length: items over the capacity in full pieces and a rest, all others whole."""
    sized = items.select(item_id.alias("item_id"), size.cast("long").alias("size")).where("size > 0")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / capacity))).alias("piece")
    return sized.select("item_id", "size", piece).select("item_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("long").alias("length"))


def assign(parts: DataFrame, capacity: int, salts: int = 64) -> DataFrame:
    """item_id, piece, start, length, container_id, offset for the pieces of pieces(). salts: how many tasks share the ranking of one length."""
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("item_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    table = places(shortest_pack_first(histogram, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("item_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.select("item_id", "piece", "start", "length", (F.col("rank") + F.col("before")).alias("rank"))
    keys = table[:, 0] * (1 << 48) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            _, first, each, container, offset = table[np.searchsorted(keys, size * (1 << 48) + rank, "right") - 1].T
            k = rank - first
            columns = [batch.column(c) for c in ("item_id", "piece", "start", "length")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(container + k // each), pa.array(offset + k % each * size)], ["item_id", "piece", "start", "length", "container_id", "offset"])

    kind = dict(ranked.dtypes)["item_id"]
    return ranked.mapInArrow(place, f"item_id {kind}, piece long, start long, length long, container_id long, offset long")


def containers(assigned: DataFrame, capacity: int) -> DataFrame:
    """container_id, n_items, n_tokens, fill and the contents in order; a container holds at most capacity pieces."""
    content = F.array_sort(F.collect_list(F.struct("offset", "item_id", "piece", "start", "length"))).alias("contents")
    total = F.sum("length")
    return assigned.groupBy("container_id").agg(F.count("*").alias("n_items"), total.alias("n_tokens"), (total / capacity).alias("fill"), content)
