"""Mixing sources to target shares of the total size, with a capped number of repeats.

The size of the mix is the largest at which every source with documents can hold its share: min over sources of max_repeats x tokens / share. A source takes as many
complete epochs as fit its budget; the rest is a weighted sample without replacement after Efraimidis and Spirakis: each document has the key -ln(u) / weight, documents
are taken by rising key until their prefix sum of tokens reaches the budget. The prefix sums are taken over key cells of a source first, and document by document only in
the one cell in which the budget ends. The cells are even in the logarithm of the key, CELLS to a factor of e: whatever the weights, such a cell is expected to hold at most
1 / (e CELLS) of a source's documents (the most a mixture of exponential keys puts there, 0.04 %), so no source is ever sorted in one task; a source has at most 43,000 cells.

Sources without documents get nothing, the share they miss is reported; sources without a target are left out. Shares that are null or negative count as 0, a null
max_repeats as 1; several rows of one source add their shares and keep the smaller cap. Documents with null id or source, or without tokens, are left out; a weight that
is not a positive number counts as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1024


def targets(table: DataFrame) -> DataFrame:
    share = F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)
    rows = table.where("source is not null").groupBy("source").agg(F.sum(F.when(F.isnan(share), 0.0).otherwise(share)).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    return rows


def quality_weight(text: Column, n_tokens: Column) -> Column:
    """A weight from 0.1 to 1: the characters one token covers, against three. Damaged and garbled text falls into many short tokens."""
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.length(text) / n_tokens / 3.0))


def plan(sized: DataFrame, goals: DataFrame, total: float | None = None) -> DataFrame:
    """Per source (as many rows as goals, a configuration table): available tokens, budget, epochs and the rest for fractional selection."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_available"))
    rows = goals.join(have, "source", "left").fillna(0, ["available", "n_available"])
    cap = F.when((F.col("available") > 0) & (F.col("target_share") > 0), F.col("max_repeats") * F.col("available") / F.col("target_share"))
    whole = F.min(cap).over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumn("mix_tokens", whole if total is None else F.least(F.lit(float(total)), whole))
    rows = rows.withColumn("budget", F.when(F.col("available") > 0, F.coalesce(F.col("target_share") * F.col("mix_tokens"), F.lit(0.0))).otherwise(0.0))
    epochs = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available") + 1e-9), F.col("max_repeats"))).otherwise(0)
    rows = rows.withColumn("epochs", epochs.cast("long"))
    return rows.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("available"))).otherwise(0.0))


def select(sized: DataFrame, planned: DataFrame, seed: int = 7) -> DataFrame:
    """sized: doc_id, source, n_tokens, weight. Returns doc_id, source, n_tokens, repeats (at least 1)."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    weight = F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")).otherwise(1.0)
    keyed = sized.select("doc_id", "source", "n_tokens", (-F.log(u) / weight).alias("key"))
    keyed = keyed.withColumn("cell", F.floor(F.log("key") * CELLS))
    cells = keyed.groupBy("source", "cell").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("before", upto - F.col("n")).join(planned.select("source", "epochs", "rest"), "source")
    state = F.when(F.col("before") + F.col("n") <= F.col("rest"), "in").when(F.col("before") < F.col("rest"), "edge").otherwise("out")
    cells = cells.select("source", "cell", "before", "epochs", "rest", state.alias("state")).where("epochs > 0 or state <> 'out'")
    rows = keyed.join(cells, ["source", "cell"])
    clear = rows.where("state <> 'edge'").withColumn("extra", (F.col("state") == "in").cast("long"))
    sofar = F.sum("n_tokens").over(Window.partitionBy("source", "cell").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # the document that crosses the budget is taken if that comes closer to it
    edge = rows.where("state = 'edge'").withColumn("extra", (F.col("before") + sofar - F.col("n_tokens") / 2 <= F.col("rest")).cast("long"))
    both = clear.unionByName(edge)
    return both.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).alias("repeats")).where("repeats > 0")


def shares(chosen: DataFrame, planned: DataFrame) -> DataFrame:
    """Per source: target and actual share, tokens, documents used and the most repeats."""
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    rows = planned.join(used, "source", "left").fillna(0, ["tokens", "n_docs", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return rows.select("source", "target_share", "max_repeats", "available", "budget", "epochs", "tokens", "n_docs", "most_repeats", (F.col("tokens") / whole).alias("actual_share"))
