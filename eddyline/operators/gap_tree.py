"""Sessions of activity by a Cartesian tree over the gaps between an entity's consecutive events.

A node of the tree is a run of events with no longer gap inside than its ``height_us``; ``parent_us`` is the smaller of the two gaps that enclose it (null at the
root). The sessions for a threshold are the nodes with ``height_us <= threshold < parent_us``: one filter over the stored tree, for any number of thresholds.

An entity's events meet in one task, where the tree is built in blocks. A hot entity, one that holds more than a 2,000th of all rows, is split into chunks (entity x time cell) first: a
chunk gives out every node that touches neither of its ends, and contracts these to single segments. What remains of n events is about 2 ln n segments (the running maxima of the gaps
from either end); only they are shuffled again, and the rest of the tree is built from the remains of all chunks of an entity in time order. There are at most 2,000 hot entities.

n_events counts the distinct non-null record ids of each time, or the distinct times if no record id is given; an id that occurs at several times counts at each of them.

Nulls: rows with null entity or time are left out. Equal times of an entity are one leaf. An empty table gives an empty tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.functions.columns import HOUR_US, floor_to
from eddyline.session import cut_lineage

NAMES = ["entity", "cell", "start_us", "end_us", "n_events", "height_us", "parent_us", "state"]
_TYPES = "entity string, cell long, start_us long, end_us long, n_events long, height_us long, parent_us long, state int"
_CLOSED, _OPEN, _INNER = 0, 1, 2
_WALL = np.iinfo(np.int64).max  # stands for the gap between two groups
_HOT_PARTS = 2000


def _jump(gaps: np.ndarray, step: int, onward: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each gap the nearest one in the direction of step that is not onward() of it. All look at once; one that has to go on takes over where its neighbour looks, so runs are
    skipped in doubling steps."""
    to = np.arange(len(gaps)) + step
    to[[0, -1]] = 0, len(gaps) - 1
    active = np.flatnonzero(gaps != _WALL)
    while len(active) > 16:
        at = to[active]
        going = onward(gaps[at], gaps[active])
        active = active[going]
        to[active] = to[at[going]]
    for i in active.tolist()[::step]:  # the few that are left, one by one, so a long fall of gaps costs no round for each
        at = int(to[i])
        while onward(gaps[at], gaps[i]):
            at = int(to[at])
        to[i] = at
    return to


def tree(rows: pa.Table, last_step: bool) -> tuple[pa.Table, pa.Table]:
    """rows: segments of whole groups (entity, cell), sorted by them and by start. Returns the closed nodes and what remains: nothing after the last step, else the groups with every
    part contracted that is bounded inside them. Of equal gaps that reach an end, the outermost on either side is kept, so evenly spaced events contract as well."""
    n = rows.num_rows
    start, end, count, height, state = (rows.column(c).to_numpy() for c in ("start_us", "end_us", "n_events", "height_us", "state"))
    gaps = np.full(n + 1, _WALL)  # gaps[k] is before segment k
    np.subtract(start[1:], end[:-1], out=gaps[1:-1])
    gaps[_edges(rows)] = _WALL
    before, beyond, after = _jump(gaps, -1, np.less), _jump(gaps, 1, np.less_equal), _jump(gaps, 1, np.less)
    upto = np.concatenate([[0], np.cumsum(count)])
    inner = np.flatnonzero((gaps != _WALL) & (gaps[before] > gaps))  # one gap of each node: the first among equals
    if not last_step:
        inner = inner[(gaps[before[inner]] != _WALL) & (gaps[beyond[inner]] != _WALL)]
    low, high = before[inner], beyond[inner] - 1
    leaf = state == _OPEN
    if not last_step:
        leaf &= (gaps[:-1] != _WALL) & (gaps[1:] != _WALL)
    leaf = np.flatnonzero(leaf)
    low, high = np.concatenate([low, leaf]), np.concatenate([high, leaf])
    closed = _table(rows, low, high, upto, np.concatenate([gaps[inner], height[leaf]]), np.minimum(gaps[low], gaps[high + 1]), np.full(len(low), _CLOSED))
    if last_step:
        return closed, closed.slice(0, 0)
    cuts = np.flatnonzero((gaps == _WALL) | (gaps[before] == _WALL) | (gaps[after] == _WALL))
    low, high = cuts[:-1], cuts[1:] - 1
    single = low == high
    inside = gaps.copy()
    inside[cuts] = -1  # the largest gap inside each part
    tall = np.where(single, height[low] if n else 0, np.maximum.reduceat(inside, low) if len(low) else 0)
    kept = np.where(single & ((gaps[low] == _WALL) | (gaps[high + 1] == _WALL)), state[low] if n else 0, _INNER)
    return closed, _table(rows, low, high, upto, tall, np.full(len(low), _WALL), kept)


def _edges(rows: pa.Table) -> np.ndarray:
    """Where groups begin, and the end."""
    if not rows.num_rows:
        return np.zeros(1, np.int64)
    entity, cell = rows.column("entity"), rows.column("cell").to_numpy()
    other = pc.not_equal(entity.slice(1), entity.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False) | (cell[1:] != cell[:-1])
    return np.concatenate([[0], np.flatnonzero(other) + 1, [rows.num_rows]])


def _table(rows: pa.Table, low: np.ndarray, high: np.ndarray, upto: np.ndarray, height: np.ndarray, parent: np.ndarray, state: np.ndarray) -> pa.Table:
    """The runs of segments from low to high as rows."""
    take = lambda c, i: rows.column(c).take(pa.array(i))
    columns = [take("entity", low), take("cell", low), take("start_us", low), take("end_us", high), pa.array(upto[high + 1] - upto[low]), pa.array(height, pa.int64())]
    return pa.table([*columns, pa.array(parent, mask=parent == _WALL), pa.array(state, pa.int32())], NAMES)


def walk(batches: Iterator[pa.RecordBatch], last_step: bool, most: int = 200_000) -> Iterator[pa.Table]:
    """Segments of a partition, sorted by entity, cell and start, in blocks of whole groups. A group of more than most segments is contracted as it grows, so memory is bounded."""
    held: list[pa.Table] = []
    size, limit = 0, most
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < limit:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        at = int(_edges(rows)[-2])  # the last group may go on
        if at:
            yield from tree(rows.slice(0, at).combine_chunks(), last_step)
        rest = rows.slice(at).combine_chunks()
        if rest.num_rows >= most:
            closed, rest = tree(rest, last_step=False)
            yield closed
            rest = rest.drop_columns(["parent_us"])
        held, size = [rest.select(batch.schema.names).cast(held[0].schema)], rest.num_rows
        limit = max(most, 2 * size)
    if size:
        yield from tree(pa.concat_tables(held).combine_chunks(), last_step)


def _in_arrow(last_step: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in walk(batches, last_step):
            yield from rows.to_batches(max_chunksize=50_000)

    return run


def gap_tree(events: DataFrame, entity: Column, time_us: Column, record_id: Column | None = None, cell_us: int = HOUR_US, hot_rows: int = 1000) -> DataFrame:
    """The tree as rows entity, start_us, end_us, n_events, height_us, parent_us.

    The entity is taken as a string. cell_us: width of the time cells of hot entities; a cell of one entity is handled in one task, so narrower cells split a hot entity further. hot_rows: an entity with fewer rows is
    never split."""
    points = events.select(entity.cast("string").alias("entity"), time_us.alias("start_us"), *([] if record_id is None else [record_id.alias("record_id")]))
    points = points.where("entity is not null and start_us is not null")
    # a sketch of frequent items, merged in one pass: at most _HOT_PARTS entities come back, and one that it misses by a little is merely not split
    n, often = points.agg(F.count("*"), F.expr(f"approx_top_k(entity, {_HOT_PARTS}, {8 * _HOT_PARTS})")).first()
    hot = [r["item"] for r in often if r["count"] > max(hot_rows, n // _HOT_PARTS)]
    is_hot = F.col("entity").isin(hot) if hot else F.lit(False)
    calm = _leaves(points.where(~is_hot).withColumn("cell", F.lit(0).cast("long")).repartition("entity"))
    calm = calm.sortWithinPartitions("entity", "cell", "start_us").mapInArrow(_in_arrow(True), _TYPES)
    if not hot:
        return calm.drop("cell", "state")
    # a hot entity's copies are met before they are shuffled
    split = points.where(is_hot).withColumn("cell", floor_to(F.col("start_us"), cell_us)).distinct().repartition("entity", "cell")
    chunks = cut_lineage(_leaves(split).sortWithinPartitions("entity", "cell", "start_us").mapInArrow(_in_arrow(False), _TYPES))
    remains = chunks.where(F.col("state") != _CLOSED).withColumn("cell", F.lit(0).cast("long")).drop("parent_us").repartition("entity")
    upper = remains.sortWithinPartitions("entity", "cell", "start_us").mapInArrow(_in_arrow(True), _TYPES)
    return calm.unionByName(chunks.where(F.col("state") == _CLOSED)).unionByName(upper).drop("cell", "state")


def _leaves(points: DataFrame) -> DataFrame:
    """A segment per entity, cell and time."""
    if "record_id" in points.columns:
        leaves = points.groupBy("entity", "cell", "start_us", "record_id").agg(F.lit(1)).groupBy("entity", "cell", "start_us").agg(F.count("record_id").alias("n_events"))
    else:
        leaves = points.groupBy("entity", "cell", "start_us").agg(F.lit(1).cast("long").alias("n_events"))
    return leaves.select("entity", "cell", "start_us", F.col("start_us").alias("end_us"), "n_events", F.lit(0).cast("long").alias("height_us"), F.lit(_OPEN).alias("state"))


def cut(tree: DataFrame, threshold_us: int) -> DataFrame:
    """The sessions: runs that a gap of more than threshold_us separates (a gap of exactly that length does not)."""
    return tree.where((F.col("height_us") <= threshold_us) & (F.col("parent_us").isNull() | (F.col("parent_us") > threshold_us)))
