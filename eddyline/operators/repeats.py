"""Messages delivered more than once: one row per identifier stays.

The identifiers are stored per time bucket of arrival with their first offset (exact within a bucket). A Bloom filter per time bucket, kept per hash shard,
screens the identifiers of each bucket against all earlier buckets; what no filter holds is new for certain. The possible repeats are verified exactly against the
stored identifiers of only the bucket whose filter matched.

Null identifiers are never repeats. A null offset sorts last, a null arrival time is a bucket of its own. Of rows with the same smallest offset one is kept.
An identifier that a third of all rows carry becomes one stored entry per bucket before the first shuffle ends (partial aggregation).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.functions.columns import DAY_US, floor_to
from eddyline.session import cut_lineage

_BITS_PER_ID, _PROBES = 16, 8
_LAST = 2**63 - 1


class Bloom:
    """A Bloom filter over 64-bit hashes, sized for n of them; a false positive in about 0.06 % of probes."""

    def __init__(self, n: int) -> None:
        size = 1 << max(6, int(n * _BITS_PER_ID - 1).bit_length())
        self.mask, self.bits = np.uint64(size - 1), np.zeros(size, bool) if size < 4096 else np.zeros(size // 8, np.uint8)
        self.packed = size >= 4096

    def dump(self) -> tuple[int, bytes]:
        """Its size in bits and its contents."""
        return int(self.mask) + 1, self.bits.tobytes()

    @classmethod
    def load(cls, size: int, bits: bytes) -> Bloom:
        bloom = cls(1)
        bloom.mask, bloom.packed = np.uint64(size - 1), size >= 4096
        bloom.bits = np.frombuffer(bits, np.uint8 if bloom.packed else bool)
        return bloom

    def _places(self, hashes: np.ndarray, i: int) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return (hashes + np.uint64(i) * step) & self.mask

    def add(self, hashes: np.ndarray) -> None:
        for i in range(_PROBES):
            at = self._places(hashes, i)
            if self.packed:
                np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
            else:
                self.bits[at] = True

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may have been added; candidates shrink with each probe."""
        left = np.arange(len(hashes))
        for i in range(_PROBES):
            at = self._places(hashes[left], i)
            hit = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 if self.packed else self.bits[at]
            left = left[hit.astype(bool)]
            if not len(left):
                break
        found = np.zeros(len(hashes), bool)
        found[left] = True
        return found


class SlicedBlooms:
    """Bloom filters of many time buckets, of one size and stored bit by bit: the word at a place has a bit for each of 64 buckets, so the words of an identifier's places tell at once
    which of 64 buckets may hold it. A bucket of more than n identifiers only has more false positives."""

    def __init__(self, n: int) -> None:
        self.size, self.words = 1 << max(6, int(n * _BITS_PER_ID - 1).bit_length()), []

    def _places(self, hashes: np.ndarray) -> list[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [((hashes + np.uint64(i) * step) & np.uint64(self.size - 1)).astype(np.int64) for i in range(_PROBES)]

    def screen(self, hashes: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of a hash, earlier bucket that may hold it); then the hashes are in the bucket, too. Buckets are numbered from 0 as they come."""
        while len(self.words) <= bucket // 64:
            self.words.append(np.zeros(self.size, np.uint64))
        places, own = self._places(hashes), np.uint64(1 << bucket % 64)
        found, buckets = [], []
        for w, words in enumerate(self.words):
            held = words[places[0]]
            for place in places[1:]:
                held &= words[place]
            if w == bucket // 64:
                held &= own - np.uint64(1)
            some = np.flatnonzero(held)
            for bit in range(64) if len(some) else ():
                hit = some[(held[some] >> np.uint64(bit)) & np.uint64(1) == 1]
                found.append(hit)
                buckets.append(np.full(len(hit), 64 * w + bit))
        words = self.words[bucket // 64]
        for place in places:
            words[place] |= own  # repeated places get the same bit
        return np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([np.zeros(0, np.int64), *buckets])


def _screen(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (src, bucket, id, h, first_offset) sorted by src and bucket -> those that an earlier bucket's filter may hold, one row per such bucket. n: identifiers a bucket of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms, names, src = SlicedBlooms(n), [], None
        for batch in batches:
            sources, buckets = batch.column("src"), batch.column("bucket").to_numpy(zero_copy_only=False)
            hashes = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            new = pc.not_equal(sources.slice(1), sources.slice(0, max(0, len(sources) - 1))).to_numpy(zero_copy_only=False) | (buckets[1:] != buckets[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(buckets)] if len(buckets) else []
            for low, high in zip(edges, edges[1:]):
                if sources[low].as_py() != src:
                    blooms, names, src = SlicedBlooms(n), [], sources[low].as_py()
                if not names or names[-1] != buckets[low]:
                    names.append(int(buckets[low]))
                index, match = blooms.screen(hashes[low:high], len(names) - 1)
                if len(index):
                    rows = batch.select(["src", "bucket", "id", "first_offset"]).take(pa.array(low + index))
                    yield rows.append_column("match_bucket", pa.array(np.array(names)[match]))

    return run


def repeats(messages: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """messages: src, id (normalised), msg_offset, arrival_us. Returns the surplus rows (src, id, msg_offset, surplus): all but one copy of each identifier.

    bucket_us: width of a time bucket; the filters of a shard have 16 bits or more for each identifier of its largest bucket, and as many for each other bucket."""
    rows = messages.where("id is not null").select(
        "src", "id", F.coalesce("msg_offset", F.lit(_LAST)).alias("msg_offset"), F.coalesce(floor_to(F.col("arrival_us"), bucket_us), F.lit(-_LAST)).alias("bucket")
    )
    stored = rows.groupBy("src", "id", "bucket").agg(F.min("msg_offset").alias("first_offset"), F.count("*").alias("n"))
    stored = cut_lineage(stored, keep_partitioning=True)
    shards = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    largest = stored.groupBy("src", "bucket").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    hashed = stored.select("src", "bucket", "id", F.xxhash64("id").alias("h"), "first_offset")
    sharded = hashed.repartition(shards, "h").sortWithinPartitions("src", "bucket")
    possible = sharded.mapInArrow(_screen(-(-largest // shards)), "src string, bucket long, id string, first_offset long, match_bucket long")
    match = stored.select("src", "id", F.col("bucket").alias("match_bucket"), F.col("first_offset").alias("match_offset"))
    verified = match.join(possible, ["src", "id", "match_bucket"])
    # an identifier's verified pairs name all of its buckets, so the store is asked by bucket again and stays where it is
    places = F.explode(F.array("bucket", "match_bucket")).alias("bucket")
    first = F.least("first_offset", "match_offset").alias("first_offset")
    keep = verified.select("src", "id", places, first).groupBy("src", "id").agg(F.min("first_offset").alias("all_first"), F.collect_set("bucket").alias("buckets"))  # at most the time buckets
    across = keep.select("src", "id", F.explode("buckets").alias("bucket"), "all_first")
    copied = stored.join(across, ["src", "id", "bucket"], "left").where("n > 1 or all_first is not null")
    copied = copied.select("src", "id", "bucket", F.coalesce("all_first", "first_offset").alias("keep_offset"))
    met = rows.join(copied, ["src", "id", "bucket"])
    counted = met.groupBy("src", "id", "msg_offset", "keep_offset").agg(F.count("*").alias("n"))
    counted = counted.withColumn("surplus", F.col("n") - (F.col("msg_offset") == F.col("keep_offset")).cast("long")).where("surplus > 0")
    return counted.select("src", "id", F.when(F.col("msg_offset") < _LAST, F.col("msg_offset")).alias("msg_offset"), "surplus")


def message_keys(df: DataFrame, src: str, record_id: Column) -> DataFrame:
    """The columns repeats() takes from a message table."""
    return df.select(F.lit(src).alias("src"), record_id.alias("id"), "msg_offset", F.unix_micros("arrival_time").alias("arrival_us"))


def first_copies(df: DataFrame, record_id: Column) -> DataFrame:
    """One row per non-null identifier, that of the smallest msg_offset, as a partial aggregate; rows with a null identifier cannot be told apart and all stay, each under a number of its own."""
    own = F.when(record_id.isNull(), F.monotonically_increasing_id())
    rows = df.select(record_id.alias("id"), own.alias("own"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    order = F.coalesce(F.col("row.msg_offset"), F.lit(_LAST))
    return rows.groupBy("id", "own").agg(F.min_by("row", order).alias("row")).select("row.*")
