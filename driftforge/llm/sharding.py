"""Operator 7: minimax contiguous sharding of atomic groups, law `bytes`.

Groups are texts, ordered by their hash; equal texts never part. The smallest capacity is found by binary search over
the ordered group sizes, each guess checked greedily over prefix sums, and the shards are cut inside that capacity, each
as near to an even share as the capacity lets it. What reaches the driver is bounded: at first the sizes of at most
2**20 hash ranges. The search is exact all the same: where the greedy check of one byte less than the capacity found
stops inside a range of several groups, that range is split further, and the search repeated, until each stop is at a
single group. Everything on the rows is JVM-side: hashes, sizes, 15 comparisons with the cuts, and slots numbered in
salted groups.

Edge cases: a null text has no bytes (size 1, crc of nothing) and is equal to the empty text; null doc_id stays null;
repeated rows each get a slot; a very long text is one group, which may be a shard of its own; with fewer groups than
shards some shards are empty; an empty table gives no rows; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftforge.llm.common import cut, number_within, table

SHARDS = 16
#: Bits of the hash that number the first ranges; parts of a range that is split.
RANGE_BITS, SPLIT = 20, 1024


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least largest sum of `shards` contiguous runs."""
    ends = np.cumsum(sizes)
    total = int(ends[-1])

    def fits(capacity: int) -> bool:
        done = 0
        for _ in range(shards):
            at = np.searchsorted(ends, done + capacity, "right")
            if at == len(ends):
                return True
            done = int(ends[at - 1]) if at else 0
        return False

    low, high = max(int(sizes.max()), -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def cuts(sizes: np.ndarray, shards: int = SHARDS) -> list[int]:
    """First group of each shard but the first; every shard's sum is within the smallest capacity."""
    if not len(sizes):
        return [0] * (shards - 1)
    capacity = smallest_capacity(sizes, shards)
    before = np.concatenate(([0], np.cumsum(sizes)))
    latest = [len(sizes)]  # from the end: the first group from which the shards that are left can hold the rest
    for _ in range(shards - 1):
        latest.append(int(np.searchsorted(before, before[latest[-1]] - capacity)))
    out, at = [], 0
    for left in range(shards, 1, -1):
        goal = before[at] + (before[-1] - before[at]) / left
        near = int(np.searchsorted(before, goal))
        if near and goal - before[near - 1] < before[min(near, len(sizes))] - goal:
            near -= 1
        most = int(np.searchsorted(before, before[at] + capacity, "right")) - 1
        at = min(max(near, latest[left - 1], at), most)
        out.append(at)
    return out


def stops(sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """The groups that the greedy check cannot take whole, one for each of `shards` runs or fewer."""
    ends = np.cumsum(sizes)
    out, done = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, done + capacity, "right"))
        if at == len(ends):
            break
        out.append(at)
        done = int(ends[at - 1]) if at else 0
    return out


def _split(rows: DataFrame, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(least key, greatest key, size) of the parts of ranges of keys: one pass over the rows."""
    low = F.when(F.lit(False), F.lit(0))
    step = F.when(F.lit(False), F.lit(1))
    for a, b in ranges:
        inside = (F.col("key") >= a) & (F.col("key") <= b)
        low, step = low.when(inside, F.lit(a)), step.when(inside, F.lit((b - a) // SPLIT + 1))
    part = rows.withColumn("low", low).where("low is not null").withColumn("part", F.floor((F.col("key") - F.col("low")) / step))
    found = part.groupBy("low", "part").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("size").alias("size"))
    return [(r.a, r.b, r["size"]) for r in found.collect()]


def first_keys(rows: DataFrame, shards: int = SHARDS) -> list[int]:
    """rows: key, size. The least key of each shard but the first."""
    shift = 64 - RANGE_BITS
    held = rows.groupBy(F.shiftright("key", shift).alias("range")).agg(F.sum("size").alias("size")).toPandas().sort_values("range")
    a = held["range"].to_numpy(np.int64) << shift
    b, sizes = a | ((1 << shift) - 1), held["size"].to_numpy(np.int64)
    while len(sizes):
        capacity = smallest_capacity(sizes, shards)
        if capacity == -(-int(sizes.sum()) // shards):
            break
        at = [i for i in stops(sizes, capacity - 1, shards) if a[i] != b[i]]
        if not at:
            break
        parts = np.array(_split(rows, [(int(a[i]), int(b[i])) for i in at]), np.int64)
        keep = np.ones(len(a), bool)
        keep[at] = False
        a, b, sizes = (np.concatenate((x[keep], parts[:, k])) for k, x in enumerate((a, b, sizes)))
        order = np.argsort(a, kind="stable")
        a, b, sizes = a[order], b[order], sizes[order]
    return [int(a[i]) if i < len(a) else None for i in cuts(sizes, shards)]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("no"),
    )
    rows = cut(rows, "sizes")
    of = sum((F.when(F.col("key") >= k, 1).otherwise(0) for k in first_keys(rows, shards) if k is not None), F.lit(0)).cast("int")
    salts = max(64, min(65_536, -(-rows.count() // 100_000)))
    numbered = number_within(rows.withColumn("shard", of).withColumn("by", F.xxhash64("no")), "shard", "by", "slot", salts)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op7_sharding": op7_sharding}
