"""Operators on message streams that keep their state between micro-batches in a shared folder.

Both take micro-batches with a rising batch id, as foreachBatch gives them. What a batch adds is written under its id, so a replayed batch writes the same again and sees only what
came before it. Every compact_every batches what the batches have added is merged, so a batch reads one merged part and at most that many small ones; the parts that went into the last
merge but one are deleted, so the last batches can still be replayed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.functions.columns import DAY_US, HOUR_US, floor_to
from eddyline.operators import late
from eddyline.operators.repeats import Bloom
from eddyline.session import cut_lineage


class _Folder:
    """Parquet folders base/name/batch=K of what each batch added, and base/name/upto=K of what all up to K came to."""

    def __init__(self, spark: SparkSession, base: str, name: str, schema: str) -> None:
        self.spark, self.base, self.schema = spark, f"{base}/{name}", schema

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self, kind: str) -> list[int]:
        """The batches with a complete folder of the kind."""
        path, fs = self._path(self.base)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        found = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
        return [k for k in found if fs.exists(self._path(f"{self.base}/{kind}={k}/_SUCCESS")[0])]

    def before(self, batch_id: int) -> DataFrame:
        """What the earlier batches wrote."""
        merged = [k for k in self.numbers("upto") if k < batch_id][-1:]
        paths = [f"{self.base}/upto={k}" for k in merged] + [f"{self.base}/batch={k}" for k in self.numbers("batch") if (not merged or k > merged[0]) and k < batch_id]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(self.schema).parquet(p) for p in paths])  # partitioned folders are tables of their own

    def of(self, batch_id: int) -> DataFrame:
        """What one batch wrote."""
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/batch={batch_id}")

    def write(self, rows: DataFrame, batch_id: int, partition_by: tuple[str, ...] = (), kind: str = "batch") -> None:
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.base}/{kind}={batch_id}")

    def merge(self, rows: DataFrame, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
        """Writes what all up to the batch came to, and deletes what an earlier merge holds as well."""
        old = [k for k in self.numbers("upto") if k < batch_id][-1:]
        self.write(rows, batch_id, partition_by, "upto")
        for kind in ("batch", "upto"):
            for k in self.numbers(kind):
                if old and (k <= old[0] if kind == "batch" else k < old[0]):
                    path, fs = self._path(f"{self.base}/{kind}={k}")
                    fs.delete(path, True)


class RepeatStore:
    """Lets each identifier pass once. The identifiers are stored by time bucket with a Bloom filter per bucket and shard; only buckets whose filter matches are read.

    shards: the identifiers of a bucket and shard are handled by one task. retention_us: buckets that end so long before the latest one are given up at the next merge, and an
    identifier of theirs would pass again; by default all are kept."""

    def __init__(self, spark: SparkSession, folder: str, bucket_us: int = DAY_US, shards: int = 64, compact_every: int = 16, retention_us: int | None = None) -> None:
        self.spark, self.bucket_us, self.shards, self.compact_every, self.retention_us = spark, bucket_us, shards, compact_every, retention_us
        self.ids = _Folder(spark, folder, "ids", "id string, bucket long")
        self.filters = _Folder(spark, folder, "filters", "shard int, bucket long, size long, bits binary")

    def feed(self, messages: DataFrame, batch_id: int) -> DataFrame:
        """messages: id, msg_offset, arrival_us and others. Returns the rows to keep: the first of each new identifier, and all without one."""
        columns = messages.columns
        row = F.struct(*[F.col(f"`{c}`") for c in columns])
        first = messages.where("id is not null").groupBy("id").agg(F.min_by(row, F.struct(F.col("msg_offset").isNull(), F.col("msg_offset"))).alias("row"))
        bucket = F.coalesce(floor_to(F.col("row.arrival_us"), self.bucket_us), F.lit(-1)).alias("bucket")
        asked = cut_lineage(first.select("id", "row", bucket, *self._hashed()))

        def screen(ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            hashes, out = ids["h"].to_numpy(np.int64).view(np.uint64), [pd.DataFrame({"id": ids["id"].iloc[:0], "bucket": np.zeros(0, np.int64)})]
            for f in filters.itertuples():
                hit = Bloom.load(f.size, f.bits).may_hold(hashes)
                out.append(pd.DataFrame({"id": ids["id"][hit], "bucket": np.full(int(hit.sum()), f.bucket, np.int64)}))
            return pd.concat(out)

        known = self.filters.before(batch_id)
        possible = cut_lineage(asked.select("id", "h", "shard").groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(screen, "id string, bucket long").distinct())
        matched = [r["bucket"] for r in possible.select("bucket").distinct().collect()]  # at most the number of time buckets
        stored = self.ids.before(batch_id).where(F.col("bucket").isin(matched)) if matched else self.ids.before(batch_id).limit(0)
        repeated = possible.join(stored.select("id", "bucket"), ["id", "bucket"]).select("id").distinct()
        fresh = cut_lineage(asked.join(repeated, "id", "left_anti"))
        self.ids.write(fresh.select("id", "bucket"), batch_id, ("bucket",))
        self.filters.write(self._filters(fresh), batch_id)
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)
        return fresh.select("row.*").unionByName(messages.where("id is null"))

    def _hashed(self) -> list:
        h = F.xxhash64("id")
        return [h.alias("h"), F.pmod(h, F.lit(self.shards)).cast("int").alias("shard")]

    def _filters(self, ids: DataFrame) -> DataFrame:
        """One filter per shard and bucket."""

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            bloom = Bloom(len(frame))
            bloom.add(frame["h"].to_numpy(np.int64).view(np.uint64))
            size, bits = bloom.dump()
            return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "bucket": [frame["bucket"].iloc[0]], "size": [size], "bits": [bits]})

        return ids.select("shard", "bucket", "h").groupBy("shard", "bucket").applyInPandas(build, "shard int, bucket long, size long, bits binary")

    def compact(self, batch_id: int) -> None:
        """Merges the identifiers of each bucket and gives it one filter per shard; leaves out buckets past the retention."""
        ids = self.ids.before(batch_id + 1)
        if self.retention_us is not None:
            latest = ids.agg(F.max("bucket")).first()[0]
            ids = ids.where(F.col("bucket") > (latest or 0) - self.retention_us)
        ids = cut_lineage(ids.select("id", "bucket").repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(self.shards))))
        self.ids.merge(ids, batch_id, ("bucket",))
        self.filters.merge(self._filters(ids.select("bucket", *self._hashed())), batch_id)


class PeriodStore:
    """Multisets of values per period, corrected as late records arrive, up to the cut-off. A period past the cut-off cannot change any more: at the next merge its multiset gives way to
    its aggregates."""

    def __init__(self, spark: SparkSession, folder: str, lateness_us: int = 6 * HOUR_US, period_us: int = HOUR_US, compact_every: int = 16) -> None:
        self.spark, self.lateness_us, self.period_us, self.compact_every = spark, lateness_us, period_us, compact_every
        self.deltas = _Folder(spark, folder, "deltas", "period_us long, value double, n long")
        self.marks = _Folder(spark, folder, "marks", "us long")
        self.closed = _Folder(spark, folder, "closed", "period_us long, n_records long, n_values long, n_distinct long, smallest double, largest double, median double")

    def feed(self, records: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """records: us, value, optionally weight (-1 takes a record back). Returns the corrected aggregates of the periods that changed, and the records after the cut-off."""
        mark = self._mark(batch_id)
        timed = records.where("us is not null").withColumn("period_us", floor_to(F.col("us"), self.period_us))
        is_late = F.lit(False) if mark is None else F.col("period_us") + self.period_us <= mark
        weight = F.col("weight") if "weight" in records.columns else None
        self.deltas.write(late.multiset(timed.where(~is_late), ["period_us"], F.col("value").cast("double"), weight), batch_id)
        self.marks.write(records.agg(F.max("us").alias("us")), batch_id)
        changed = self.deltas.of(batch_id).select("period_us").distinct()
        corrected = late.derive(self.state(batch_id).join(changed, "period_us", "left_semi"), ["period_us"])
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)
        return corrected, timed.where(is_late)

    def _mark(self, batch_id: int) -> int | None:
        """The watermark before a batch."""
        latest = self.marks.before(batch_id).agg(F.max("us")).first()[0]
        return None if latest is None else latest - self.lateness_us

    def state(self, batch_id: int) -> DataFrame:
        """The multisets after a batch of the periods that may still change: the sum of what the batches added."""
        return self.deltas.before(batch_id + 1).groupBy("period_us", "value").agg(F.sum("n").alias("n")).where("n <> 0")

    def aggregates(self, batch_id: int) -> DataFrame:
        """What all periods came to after a batch."""
        return self.closed.before(batch_id + 1).unionByName(late.derive(self.state(batch_id), ["period_us"]))

    def compact(self, batch_id: int) -> None:
        """Merges the multisets; those of the periods that records of later batches cannot enter any more become aggregates."""
        mark = self._mark(batch_id + 1)
        state = cut_lineage(self.state(batch_id))
        over = F.lit(False) if mark is None else F.col("period_us") + self.period_us <= mark
        # written as the batch's part: parts of closed periods are only added, never rewritten
        self.closed.write(late.derive(state.where(over), ["period_us"]), batch_id)
        self.deltas.merge(state.where(~over), batch_id)
        self.marks.merge(self.marks.before(batch_id + 1).agg(F.max("us").alias("us")), batch_id)


def batches(df: DataFrame, column: str) -> Iterator[tuple[int, DataFrame]]:
    """The rows per value of a batch column in order, for replaying a table; as many steps as there are batches."""
    for k, row in enumerate(df.select(column).distinct().orderBy(column).collect()):
        yield k, df.where(F.col(column) == row[0])
