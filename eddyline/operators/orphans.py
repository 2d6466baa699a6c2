"""References to records that do not exist, directly or through an orphaned parent.

A graph of foreign keys is declared as edges from referring to referred tables. Direct orphans come from anti joins on distinct references (the hot reference
of a third of all rows is one row by then); the cascade then follows the graph to its fixpoint: a child of an orphaned record is an inherited orphan.

Nulls: a null record or reference is no case. Copies of a record count once. Empty tables: every reference to one is an orphan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyline.session import cut_each


@dataclass(frozen=True)
class Edge:
    """References of one table: child(record_id, ref_id, day) against the ids of parent; orphans: the references that lead nowhere (record_id, ref_id, day)."""

    child: str
    parent: str
    references: DataFrame
    orphans: DataFrame


def references(df: DataFrame, record_id: Column, ref_id: Column, at: Column) -> DataFrame:
    """Distinct record_id, ref_id, at of the rows in which neither id is null."""
    return df.select(record_id.alias("record_id"), ref_id.alias("ref_id"), at.alias("at")).where("record_id is not null and ref_id is not null").distinct()


def missing(refs: DataFrame, parents: DataFrame, parent_id: Column) -> DataFrame:
    """The references whose ref_id no row of parents has."""
    known = parents.select(parent_id.alias("ref_id")).where("ref_id is not null").distinct()
    lost = refs.select("ref_id").distinct().join(known, "ref_id", "left_anti")
    return refs.join(lost, "ref_id", "left_semi")


def lifetimes(changes: DataFrame, key: Column, at: Column, alive: Column) -> DataFrame:
    """The spans [born, died) in which each key exists: from one change to the next; null died: still alive. Of changes at the same instant a deletion is the last."""
    rows = changes.select(key.alias("ref_id"), at.alias("born"), alive.alias("alive")).where("ref_id is not null and born is not null").groupBy("ref_id", "born").agg(F.min("alive").alias("alive"))
    order = Window.partitionBy("ref_id").orderBy("born")
    return rows.withColumn("died", F.lead("born").over(order)).where("alive").select("ref_id", "born", "died")


def missing_then(refs: DataFrame, alive: DataFrame) -> DataFrame:
    """The references with a time at which ref_id was unknown, deleted or not yet created."""
    r, a = refs.where("at is not null").alias("r"), alive.alias("a")
    return r.join(a, (F.col("r.ref_id") == F.col("a.ref_id")) & (F.col("r.at") >= F.col("a.born")) & (F.col("a.died").isNull() | (F.col("r.at") < F.col("a.died"))), "left_anti")


def _together(parts: list[DataFrame]) -> DataFrame:
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).distinct()


def cascade(edges: list[Edge]) -> DataFrame:
    """All orphans: src_table, parent, record_id, ref_id, at, kind ('direct' or 'inherited'), depth; a table may have several foreign keys, and refer to itself.

    Each round joins the referring tables with the parents newly found orphaned, and is written to the checkpoint folder; the last round is the one that adds no row. A reference that is
    both direct and inherited is direct; an inherited one has the depth of the first round that reaches it."""
    keys = list(dict.fromkeys((e.child, e.parent) for e in edges))
    refs = {k: _together([e.references for e in edges if (e.child, e.parent) == k]) for k in keys}
    direct = cut_each([_together([e.orphans for e in edges if (e.child, e.parent) == k]) for k in keys])
    found = {k: df.withColumns({"kind": F.lit("direct"), "depth": F.lit(0)}) for k, df in zip(keys, direct)}
    fresh, depth = {k: rows for k, rows in found.items() if not rows.isEmpty()}, 0
    while fresh:
        depth += 1
        heirs_of: dict[tuple[str, str], DataFrame] = {}
        for k in keys:
            new = [rows.select(F.col("record_id").alias("ref_id")) for (child, _), rows in fresh.items() if child == k[1]]
            if new:
                heirs = refs[k].join(reduce(DataFrame.unionByName, new).distinct(), "ref_id", "left_semi")
                known = found[k].select("record_id", "ref_id")
                heirs_of[k] = heirs.join(known, ["record_id", "ref_id"], "left_anti")
        met = {k: df.withColumns({"kind": F.lit("inherited"), "depth": F.lit(depth)}) for k, df in zip(heirs_of, cut_each(list(heirs_of.values())))}
        reached = {k: rows for k, rows in met.items() if not rows.isEmpty()}
        for k, rows in reached.items():
            found[k] = found[k].unionByName(rows)
        fresh = reached
    parts = [rows.select(F.lit(child).alias("src_table"), F.lit(parent).alias("parent"), "record_id", "ref_id", "at", "kind", "depth") for (child, parent), rows in found.items()]
    return reduce(DataFrame.unionByName, parts)
