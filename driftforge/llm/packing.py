"""Operator 9: best-fit decreasing packing into windows of 2048 tokens.

Documents longer than a window are cut into full windows first. Best fit depends on lengths alone, and there are at
most 2048 of them: the plan is made from the number of pieces of each length, for runs of equal pieces and equally
full windows at once, with a segment tree over remaining capacities that finds the tightest open window. Its size is
bounded by the window, whatever the number of documents. Pieces then find their run by their number within their
length, which is counted in salted groups.

Edge cases: null text is empty, and every document has at least its end id; null doc_id stays null; rows that repeat
a doc_id are packed each; a very long text makes many full windows; an empty table gives an empty result; other columns
are left alone, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftforge.llm.common import arrow_rows, blobs, cut, keyed, number_within, small_batches, table
from driftforge.llm.encode import encoder

WINDOW = 2048
END = 1


class CapacityTree:
    """A segment tree over remaining capacities 0 to n: which hold open windows, and the least at or above a value."""

    def __init__(self, n: int) -> None:
        self.size = 1
        while self.size <= n:
            self.size *= 2
        self.any = [False] * (2 * self.size)

    def set(self, r: int, value: bool) -> None:
        i = r + self.size
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, r: int) -> int | None:
        i = r + self.size
        if r >= self.size:
            return None
        if self.any[i]:
            return r
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """counts: pieces of each length. Runs (length, first number, pieces, first window, pieces a window, offset).

    Piece number first + x of that length goes to window first_window + x // per, at offset + length * (x % per).
    The same windows as piece by piece: once the tightest window holds a piece, it stays the tightest while more fit.
    """
    tree, open_, runs, opened = CapacityTree(window), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                per = window // length
                have, first = -(-left // per), opened
                opened += have
                r = window
            else:
                per = r // length
                first, have = open_[r].pop()
                if not open_[r]:
                    tree.set(r, False)
            used = min(have, -(-left // per))
            if used < have:
                open_.setdefault(r, []).append((first + used, have - used))
                tree.set(r, True)
            pieces = min(left, used * per)
            runs.append((length, number, pieces, first, per, window - r))
            full, rest = divmod(pieces, per)
            for at, n, held in ((first, full, per), (first + full, 1 if rest else 0, rest)):
                if n and r - held * length > 0:
                    open_.setdefault(r - held * length, []).append((at, n))
                    tree.set(r - held * length, True)
            number += pieces
            left -= pieces
    return runs


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, key (tells rows apart)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("key", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in it:
            out: dict[str, list] = {f.name: [] for f in schema}
            for d, k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), blobs(b, "text"), strict=True):
                ids = np.frombuffer(enc.ids(x) + END.to_bytes(2, "little"), "<u2").astype("<u4")
                for at in range(0, len(ids), WINDOW):
                    part = ids[at : at + WINDOW]
                    for name, v in zip(out, (d, at, len(part), zlib.crc32(part.tobytes()), len(ids), k), strict=True):
                        out[name].append(v)
            yield from arrow_rows(out, schema)

    small_batches(docs.sparkSession)
    rows = keyed(docs).select("doc_id", "text", F.xxhash64("did", "rk").alias("key"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, key long")


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut_ = cut(pieces(docs, tokenizer), "pieces")
    counts = {r["length"]: r["count"] for r in cut_.groupBy("length").count().collect()}  # at most 2048 rows
    runs = spark.createDataFrame(best_fit_decreasing(counts) or [(0, 0, 0, 0, 1, 0)], "r_length long, r_first long, r_pieces long, r_window long, r_per long, r_offset long")
    # a salted group holds about 10,000 pieces even if all have one length
    salts = max(8, min(65_536, -(-sum(counts.values()) // 10_000)))
    numbered = number_within(cut_.withColumn("piece_key", F.xxhash64("key", "start")), "length", "piece_key", "number", salts)
    # the runs of one length lie side by side: the run of a number is the last that starts at or before it
    ends = runs.groupBy("r_length").agg(F.sort_array(F.collect_list(F.struct("r_first", "r_window", "r_per", "r_offset"))).alias("runs"))
    found = numbered.join(F.broadcast(ends), numbered.length == ends.r_length)
    run = F.element_at(F.filter("runs", lambda r: r["r_first"] <= F.col("number")), -1)
    x = F.col("number") - F.col("run.r_first")
    return found.withColumn("run", run).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("run.r_window") + F.floor(x / F.col("run.r_per"))).cast("long").alias("sequence_id"),
        (F.col("run.r_offset") + F.col("length") * (x % F.col("run.r_per"))).cast("long").alias("offset"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents; an empty table gives none."""
    return pack(docs)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
