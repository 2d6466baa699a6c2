"""Percentiles per group by dyadic Count-sketches.

A double is encoded by all its 64 bits in an order-preserving form, so different values keep different codes and a code decodes to its value. The upper 14 bits are counted
exactly; each of the 50 finer binary resolutions has a signed Count-sketch of 5 x 512 counters. Sketches merge by addition and take deletions as negative weights. A rank is inverted by
finding its cell in the exact counts and descending the levels from there. The rank error is at most EPSILON x n + 1 with high probability, with ties too; up to 4,096 different values
are listed with their counts and give exact answers.

Null and NaN values are left out, infinite ones count as the largest. Null group values are a group of their own. An empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_BITS, EXACT_BITS, ROWS, WIDTH = 64, 14, 5, 512
SKETCHED = CODE_BITS - EXACT_BITS
SIZE = (1 << EXACT_BITS) + SKETCHED * ROWS * WIDTH
EPSILON = 0.01
_LISTED = 4096  # different codes that are listed before they become counters
_BUFFERED = 16_384  # codes that wait to be counted together
_TOGETHER = 128  # partitions whose partial results meet in a first step
_HELD = 8_000_000  # numbers in memory before partial results are given out


_INFINITY = 0x7FF0 << 48
_LOWEST = -(1 << (EXACT_BITS - 1))  # the least prefix that is counted exactly


def encode(values: np.ndarray) -> np.ndarray:
    """Order-preserving codes."""
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def decode(code: int) -> float:
    """The value with that code; codes past the infinite ones belong to them."""
    code = min(max(code, ~_INFINITY), _INFINITY)
    return float(np.array([code if code >= 0 else code ^ ((1 << 63) - 1)], np.int64).view(np.float64)[0])


_OFFSETS = np.arange(1, SKETCHED * ROWS + 1, dtype=np.uint64).reshape(SKETCHED, ROWS) * np.uint64(0x9E3779B97F4A7C15)


def _hashes(prefix: np.ndarray, level: int, row: int | slice) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of each prefix in one row, or (as further axis) in several."""
    x = prefix.astype(np.uint64) + _OFFSETS[level, row]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # fixed values: the published splitmix64 constants
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x & np.uint64(WIDTH - 1)).astype(np.int64), ((x >> np.uint64(32)) & np.uint64(1)).astype(np.int64) * 2 - 1


def _at(level: int, row: int) -> int:
    return (1 << EXACT_BITS) + (level * ROWS + row) * WIDTH


def _net(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in rising order, with its total weight."""
    if not len(codes):
        return codes, weights
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[starts], np.add.reduceat(weights, starts)


def add(sketch: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> None:
    """Adds the codes to the counters."""
    codes, weights = _net(codes, weights)
    for level in reversed(range(SKETCHED)):
        column, sign = _hashes(codes[:, None], level, slice(None))
        np.add.at(sketch, _at(level, 0) + np.arange(ROWS) * WIDTH + column, sign * weights[:, None])
        codes, weights = _net(codes >> 1, weights)
    np.add.at(sketch, codes - _LOWEST, weights)


class Summary:
    """A sketch that starts as the list of its codes and weights, as long as few codes differ; it describes the same counters."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.n, self.counters = 0, None

    def add(self, codes: np.ndarray, weights: np.ndarray) -> None:
        self.codes.append(codes)
        self.weights.append(weights)
        self.n += len(codes)
        if self.n > _BUFFERED:
            self.settle()

    def load(self) -> int:
        """How many numbers it holds, itself as 64."""
        return 64 + 2 * self.n + (0 if self.counters is None else SIZE)

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """The codes that are not in the counters, each once in rising order, and their weights."""
        codes, weights = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.codes, self.weights))
        codes, weights = _net(codes, weights)
        codes, weights = codes[weights != 0], weights[weights != 0]
        self.codes, self.weights, self.n = [codes], [weights], len(codes)
        return codes, weights

    def settle(self) -> None:
        """Chooses the form: counters once there are too many codes to list."""
        if self.counters is not None or len(self.listed()[0]) > _LISTED:
            self.sketch()

    def sketch(self) -> np.ndarray:
        """The counters, with everything added."""
        if self.counters is None:
            self.counters = np.zeros(SIZE, np.int64)
        if self.codes:
            add(self.counters, *self.listed())
        self.codes, self.weights, self.n = [], [], 0
        return self.counters

    def merge(self, blob: bytes) -> None:
        data = zlib.decompress(blob[1:])
        if blob[:1] == b"c":
            if self.counters is None:
                self.counters = np.zeros(SIZE, np.int64)
            self.counters += np.frombuffer(data, "<i8")
        else:
            n = len(data) // 16
            self.add(np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n))

    def pack(self) -> bytes:
        self.settle()
        if self.counters is not None:
            return b"c" + zlib.compress(self.sketch().astype("<i8").tobytes(), 1)
        codes, weights = self.listed()
        return b"l" + zlib.compress(codes.astype("<i8").tobytes() + weights.astype("<i8").tobytes(), 1)

    def answer(self, probabilities: list[float]) -> tuple[int, list[float | None]]:
        """n and the values of ranks ceil(q n), exact while the codes are listed."""
        self.settle()
        if self.counters is not None:
            sketch = self.sketch()
            return int(sketch[: 1 << EXACT_BITS].sum()), quantiles(sketch, probabilities)
        codes, weights = self.listed()
        counts = np.cumsum(weights)
        n = int(counts[-1]) if len(counts) else 0
        if n <= 0:
            return n, [None] * len(probabilities)
        return n, [decode(int(c)) for c in codes[np.searchsorted(counts, _ranks(probabilities, n))]]


def unpack(blob: bytes) -> np.ndarray:
    whole = Summary()
    whole.merge(blob)
    return whole.sketch()


def _ranks(probabilities: list[float], n: int) -> np.ndarray:
    return np.maximum(1, np.ceil(np.array(probabilities) * n))


def _counts(sketch: np.ndarray, level: int, prefixes: np.ndarray) -> np.ndarray:
    """Estimated counts of the prefixes: the median over the rows."""
    column, sign = _hashes(prefixes[:, None], level, slice(None))
    return np.median(sketch[_at(level, 0) + np.arange(ROWS) * WIDTH + column] * sign, axis=1)


def quantiles(sketch: np.ndarray, probabilities: list[float]) -> list[float | None]:
    """The values of ranks ceil(q n), by descent."""
    exact = np.cumsum(sketch[: 1 << EXACT_BITS])
    n = int(exact[-1])
    if n <= 0:
        return [None] * len(probabilities)
    rank = _ranks(probabilities, n)
    node = np.searchsorted(exact, rank)
    below = np.where(node > 0, exact[np.maximum(node, 1) - 1], 0)
    rank, held, node = rank - below, (exact[node] - below).astype(float), node + _LOWEST
    for level in range(SKETCHED):
        left, right = _counts(sketch, level, 2 * node), _counts(sketch, level, 2 * node + 1)
        left = np.clip((left + held - right) / 2, 0.0, held)
        goes_left = rank <= left + 0.5
        node, rank, held = 2 * node + ~goes_left, np.where(goes_left, rank, rank - left), np.where(goes_left, left, held - left)
    return [decode(int(code)) for code in node]


def sketches(df: DataFrame, value: Column, *groups: Column, weight: Column | None = None) -> DataFrame:
    """One sketch per group: groups, sketch. weight: 1 adds, -1 deletes."""
    kind = [f.dataType.simpleString() for f in df.select(*groups).schema]
    names = df.select(*groups).columns
    rows = df.select(*groups, value.cast("double").alias("_value"), (F.lit(1) if weight is None else weight).cast("long").alias("_weight"))
    rows = rows.where("_value is not null and not isnan(_value)")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Summary] = {}
        salt = TaskContext.get().partitionId() // _TOGETHER
        types: list[pa.DataType] = []

        def give() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in held], types[i]) for i in range(len(names))]
            blobs = pa.array([s.pack() for s in held.values()], pa.binary())
            out = pa.RecordBatch.from_arrays([*columns, pa.array([salt] * len(held), pa.int32()), blobs], [*names, "_salt", "sketch"])
            held.clear()
            return out

        for batch in batches:
            types = [batch.schema.field(n).type for n in names]
            if not batch.num_rows:
                continue
            group = batch.select(names).to_pandas().groupby(names, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
            codes, weights = encode(batch.column("_value").to_numpy())[order], batch.column("_weight").to_numpy()[order]
            for low, high in zip(starts, np.append(starts[1:], len(order))):
                key = tuple(batch.column(n)[int(order[low])].as_py() for n in names)
                if key not in held:
                    held[key] = Summary()
                held[key].add(codes[low:high], weights[low:high])
            if sum(s.load() for s in held.values()) > _HELD:
                yield give()
        if held:
            yield give()

    columns = ", ".join(f"`{n}` {k}" for n, k in zip(names, kind))
    parts = rows.mapInArrow(partial, f"{columns}, _salt int, sketch binary")
    return merge(_merged(parts, [*names, "_salt"]), *names)


def _merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) == 1:
            return frame[[*keys, "sketch"]]
        whole = Summary()
        for blob in frame["sketch"]:
            whole.merge(blob)
        return pd.DataFrame([[*frame.iloc[0][keys], whole.pack()]], columns=[*keys, "sketch"])

    types = dict(parts.dtypes)
    spark = parts.sparkSession
    several = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    spread = parts.repartition(several, *keys)  # small rows, much work: not to be coalesced, nor cut finer than there are cores
    return spread.groupBy(*keys).applyInPandas(total, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", sketch binary")


def merge(partial: DataFrame, *groups: str) -> DataFrame:
    """Sketches of coarser groups, by addition."""
    return _merged(partial.select(*groups, "sketch"), list(groups))


def percentiles(sketched: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """groups, n, one column per probability and epsilon; the rank error is at most epsilon x n + 1."""
    names = [c for c in sketched.columns if c != "sketch"]
    kinds = dict(sketched.dtypes)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[list[Any]] = []
            for blob in frame["sketch"]:
                whole = Summary()
                whole.merge(blob)
                n, values = whole.answer(list(probabilities.values()))
                rows.append([n, *values, EPSILON])
            found = pd.DataFrame(rows, columns=["n", *probabilities, "epsilon"], index=frame.index)
            yield pd.concat([frame[names], found], axis=1)

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "n long", *(f"{p} double" for p in probabilities), "epsilon double"])
    return sketched.mapInPandas(answer, schema)
