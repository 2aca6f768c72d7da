"""Operator 8: benchmark decontamination by SimHash of item-sized windows.

An item is a multiset of 5-word shingles. Windows of as many words as the item has are fingerprinted (a window's bit
sums are a difference of prefix sums, formed once for all items of one length) and looked up in a multi-index: 8 blocks
of 8 bits, each with the items within 3 bits of every block value, so that all items within 24 bits are found
(pigeonhole). Candidates are verified exactly: the weighted Jaccard similarity of the shingle counts must reach 0.8.

Windows are only formed around an item's rare shingles: a similarity of 0.8 needs four fifths of the item's shingles, so
of its rarest ones that make up more than a fifth at least one is in the window. A shingle that very many items share
is hardly ever among these. Documents stream past; nothing of them is shuffled.

Benchmark items are broadcast, CHUNK items at a time, so what is broadcast is bounded; larger benchmarks take more passes.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Items of fewer than five words are
one shingle of their own length, looked up as such in every document. Edge cases: null or wordless texts match nothing;
a document shorter than an item is one window; a very long text is searched region by region; of equally similar windows
the first counts; null doc_id stays null; repeated rows are matched each, repeated items are each found; empty tables
give no rows; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from driftforge.llm.common import NO_ID, arrow_rows, blobs, filtered, small_batches, table
from driftforge.llm.licences import licence_words as words_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
CHUNK = 4096


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def _shingles(t: list, size: int) -> list[tuple]:
    return list(zip(*(t[i:] for i in range(size)), strict=False))


class _Signs(dict):
    """Shingle -> +1 and -1 for the bits of its hash; only shingles near items are ever asked for."""

    bound = 200_000

    def __missing__(self, s: tuple) -> np.ndarray:
        if len(self) >= self.bound:
            self.clear()
        h = np.array([xxh64_intdigest(repr(s).encode())], "<u8")
        self[s] = v = 2 * np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int32) - 1
        return v


class Index:
    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.ids = _Vocabulary()
        self.signs = _Signs()
        self.items: list[tuple[list[int], int, Counter]] = []  # item_ids of the same words, words, shingle counts
        known: dict[tuple, int] = {}
        prints = []
        for item, text in items:
            t = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text))
            if not t:
                continue
            if t in known:
                self.items[known[t]][0].append(item)
                continue
            known[t] = len(self.items)
            counts = Counter(_shingles(t, min(SHINGLE, len(t))))
            self.items.append(([item], len(t), counts))
            prints.append(sum((n * self.signs[s] for s, n in counts.items()), np.zeros(64, np.int64)) > 0)
        in_items = Counter(s for _, _, counts in self.items for s in counts)
        self.where: dict[tuple, list[int]] = {}  # rare shingle -> items
        for i, (_, _, counts) in enumerate(self.items):
            slack = counts.total() - math.ceil(SIMILARITY * counts.total() - 1e-9)
            for s in sorted(counts, key=lambda s: (in_items[s], s)):
                self.where.setdefault(s, []).append(i)
                slack -= counts[s]
                if slack < 0:
                    break
        self.sizes = sorted({len(s) for s in self.where})
        self.rare = np.zeros(len(self.ids) + 1, bool)  # words of rare shingles
        self.rare[[w for s in self.where for w in s]] = True
        self.packed = np.packbits(np.array(prints, bool).reshape(-1, 64), axis=1, bitorder="little")  # items x 8 blocks
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= RADIUS // 8
        self.table = [near[:, self.packed[:, b]] for b in range(8)]  # of each block: value x items

    def within(self, prints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of fingerprints within RADIUS: by blocks, then exactly."""
        packed = np.packbits(prints, axis=1, bitorder="little")
        found = np.zeros((len(prints), len(items)), bool)
        for b in range(8):
            found |= self.table[b][packed[:, b][:, None], items]
        w, k = np.nonzero(found)
        near = np.bitwise_count(packed[w] ^ self.packed[items[k]]).sum(1, dtype=np.int64) <= RADIUS
        return w[near], items[k[near]]

    def search(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity): the best window of each matched item, the first of equals."""
        words = words_of(text)
        t = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        n = len(t)
        on = np.concatenate(([0], self.rare[t].astype(np.int8), [0]))
        edge = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
        # windows of one length are formed once, whichever items ask for them
        groups: dict[tuple[int, int], tuple[set, set]] = {}  # words, shingle size -> items, ranges of starts
        for size in self.sizes:
            for a, b in edge[edge[:, 1] - edge[:, 0] >= size].tolist():
                run = t[a:b].tolist()
                for k in range(len(run) - size + 1):
                    for i in self.where.get(tuple(run[k : k + size]), ()):
                        length = min(self.items[i][1], n)
                        who, at = groups.setdefault((length, size), (set(), set()))
                        if size < SHINGLE and i in who:  # a shorter shingle is its whole item: the first place is the best
                            continue
                        who.add(i)
                        at.add((max(0, a + k - length + size), min(a + k, n - length)))
        if not groups:
            return []
        # words that no item has get numbers of their own here, so that different words stay different
        own: dict[bytes, int] = {}
        full = [x or -own.setdefault(w, len(own) + 1) for x, w in zip(t.tolist(), words, strict=True)]
        best: dict[int, tuple[float, int, int]] = {}
        for (length, size), (who, ranges) in groups.items():
            items = np.array(sorted(who))
            for part in _regions(ranges):
                self._windows(full, part, length, size, items, best)
        return sorted(((item, s, k, sim) for i, (sim, s, k) in best.items() for item in self.items[i][0]), key=lambda r: (r[0] is None, r[0] or 0))

    def _windows(self, full: list[int], starts: range, length: int, size: int, items: np.ndarray, best: dict) -> None:
        region = full[starts[0] : starts[-1] + length]
        shingles = _shingles(region, size)
        each = len(shingles) - len(starts) + 1
        sums = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum([self.signs[s] for s in shingles], axis=0)))
        prints = sums[each:] - sums[:-each] > 0
        last, mine = -1, Counter()
        for w, i in zip(*(x.tolist() for x in self.within(prints, items)), strict=True):
            if w != last:
                last, mine = w, Counter(shingles[w : w + each])
            counts = self.items[i][2]
            both = sum(min(n, mine[s]) for s, n in counts.items())
            sim = both / (counts.total() + each - both)
            if sim >= SIMILARITY and (i not in best or (sim, -starts[w]) > (best[i][0], -best[i][1])):
                best[i] = (sim, starts[w], length)


def _regions(ranges: set[tuple[int, int]], most: int = 512) -> Iterator[range]:
    """Inclusive ranges of starts, joined where they meet and cut at `most` starts."""
    at = -1
    for a, b in sorted(ranges):
        a = max(a, at)
        for first in range(a, b + 1, most):
            yield range(first, min(b + 1, first + most))
        at = max(at, b + 1)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, window_words, similarity: the best window of each document and matched item."""
    schema = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("rk", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("window_words", pa.int64()), ("similarity", pa.float64())])
    text = F.coalesce("text", F.lit(""))
    did = F.col("doc_id").cast("long")
    rows = docs.select(did.alias("doc_id"), F.coalesce(did, F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("rk"), text.alias("text"))
    small_batches(docs.sparkSession)
    found = None
    for kept in _chunks(docs, benchmark):

        def run(it: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            index = Index(kept.value)
            for b in it:
                out: dict[str, list] = {f.name: [] for f in schema}
                for d, k, r, x in zip(*(b.column(i).to_pylist() for i in range(3)), blobs(b, "text"), strict=True):
                    for hit in index.search(x) if index.items else ():
                        for name, v in zip(out, (d, k, r, *hit), strict=True):
                            out[name].append(v)
                yield from arrow_rows(out, schema)

        part = rows.mapInArrow(run, "doc_id long, did long, rk long, item_id long, first_word long, window_words long, similarity double")
        found = part if found is None else found.union(part)
    return found


def _chunks(docs: DataFrame, benchmark: DataFrame) -> Iterator[Broadcast]:
    """The benchmark, about CHUNK items at a time."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chunks = max(1, -(-items.count() // CHUNK))
    for c in range(chunks):
        mine = sorted(((r.item_id, r.text.encode()) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield docs.sparkSession.sparkContext.broadcast(mine)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leaks() names."""
    for kept in _chunks(docs, benchmark):

        def chooser(kept=kept):
            index = Index(kept.value)
            return lambda b: [not (index.items and index.search(x or b"")) for x in blobs(b, "text")]

        docs = filtered(docs, chooser)
    return docs


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; null texts and null doc_ids stay, empty tables stay empty."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("did", "rk")


QUERIES = {"op8_decontamination": op8_decontamination}
