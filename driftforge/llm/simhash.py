"""Operator 2: near copies by SimHash, found by ball hashing from both sides.

Fingerprints a and b at distance 3 or less have variants u of a and u' of b, each at most one bit away from its
own, with u and u' at most one bit apart. So every distinct fingerprint emits all its variants within one flipped
bit (half the radius, rounded down), and to absorb the odd bit, one of three blocks of bits is left out of the
shuffle key: variants that agree outside the block meet, and inside a key u and u' are compared by looking up each
of the block's one-bit neighbours in the sorted variants. That needs 132 rows for a fingerprint, keys of 42 bits, and
work in proportion to a group, never its square. All colliding pairs are deduplicated and verified.

Edge cases: null or wordless text has fingerprint zero and links like any other; null doc_id stays null and never
names a component unless all its members are null; rows that repeat a doc_id get their own fingerprints; a very long
text is summed piece by piece; an empty table gives no rows; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from driftforge.llm.common import NO_ID, arrow_rows, blobs, cut, ints, keyed, small_batches, table, whole_rows
from driftforge.llm.components import components

RADIUS = 3
WORDS = 3
#: Bits of the three blocks.
BLOCKS = [(0, 21), (21, 42), (42, 64)]
_INSIDE = np.array([sum(1 << b for b in range(*x)) for x in BLOCKS], np.uint64)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    w = text.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.array([xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        set_ += np.unpackbits(h[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, did, rk, fp (the fingerprint's bits as a long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("rk", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([fingerprint(x, words) for x in blobs(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(ints(b, "did")), pa.array(ints(b, "rk")), pa.array(fp)], schema=schema)

    small_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, "doc_id long, did long, rk long, fp long")


def _balls(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        every = ints(b, "fp").view(np.uint64)
        for at in range(0, len(every), 4096):
            fp = every[at : at + 4096]
            for j, inside in enumerate(_INSIDE):
                flips = np.concatenate(([np.uint64(0)], _BIT[(_BIT & inside) == 0]))
                keys = ((fp[:, None] ^ flips) & ~inside).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), j, np.int8)), pa.array(keys.view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], names=["j", "key", "fp"])


def _pairs(j: int, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one block and sorted keys: enough pairs within the radius to connect all that are within it."""
    inside, bits = _INSIDE[j], _BIT[(_BIT & _INSIDE[j]) != 0]
    own = (fp & ~inside) == key
    base = key | (fp & inside)
    u = np.concatenate((base, (base[own][:, None] ^ bits).ravel()))
    f = np.concatenate((fp, np.repeat(fp[own], len(bits))))
    order = np.lexsort((f, u))
    u, f = u[order], f[order]
    start = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    uniq, rep = u[start], f[start]
    a, b = [np.repeat(rep, np.diff(np.concatenate((start, [len(u)]))))], [f]
    for bit in bits:
        other = uniq ^ bit
        at = np.minimum(np.searchsorted(uniq, other), len(uniq) - 1)
        hit = (uniq[at] == other) & (uniq < other)
        a.append(rep[hit])
        b.append(rep[at[hit]])
    a, b = np.concatenate(a), np.concatenate(b)
    keep = a != b
    a, b = a[keep], b[keep]
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS]
    return pairs[:, 0], pairs[:, 1]


def _meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (j, key). Keys with one fingerprint go at once."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held: list[np.ndarray] = []
    size = 0

    def flush(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        if not held:
            return
        rows = np.concatenate(held, 1)
        if not whole:  # the last key may go on in the next batch
            same = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            last = len(same) - np.count_nonzero(same)
            held, size = [rows[:, last:]], rows.shape[1] - last
            rows = rows[:, :last]
        else:
            held, size = [], 0
        if rows.shape[1]:
            eq = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
            many = np.concatenate((eq, [False])) | np.concatenate(([False], eq))
            rows = rows[:, many]
            for j in range(3):
                sel = rows[0] == j
                if sel.any():
                    a, b = _pairs(j, rows[1, sel].view(np.uint64), rows[2, sel].view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    for b in it:
        held.append(np.stack([ints(b, c).astype(np.int64) for c in ("j", "key", "fp")]))
        size += b.num_rows
        if size >= 200_000:
            yield from flush(False)
    yield from flush(True)


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct `fp`. (u, v): pairs at distance 3 or less that connect all fingerprints so linked."""
    balls = fps.select("fp").mapInArrow(_balls, "j byte, key long, fp long")
    return balls.repartition("j", "key").sortWithinPartitions("j", "key").mapInArrow(_meet, "u long, v long").distinct()


def near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, did, rk, fp, component (did and rk of its least member), component_id."""
    prints = cut(fingerprints(docs, words), "fingerprints")
    least = cut(prints.groupBy("fp").agg(F.min(F.struct("did", "rk")).alias("least")), "least")
    roots = components(links(least))
    rooted = least.join(roots, least.fp == roots.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of = rooted.join(best, "root").select("fp", "component")
    named = F.when(F.col("component.did") != NO_ID, F.col("component.did"))
    return prints.join(of, "fp").withColumn("component_id", named)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the least doc_id stays; of its identical rows, one.

    A null doc_id is larger than any other; null texts are copies of each other; an empty table stays empty.
    """
    found = near_copies(docs)
    first = found.where("component.did = did and component.rk = rk").groupBy("did", "rk").agg(F.count(F.lit(1)).alias("copies"))
    first = cut(first, "kept")
    kept = whole_rows(docs).join(first, ["did", "rk"])
    single = kept.where("copies = 1").select("__row.*")
    if first.where("copies > 1").isEmpty():
        return single
    return single.union(kept.where("copies > 1").groupBy("did", "rk").agg(F.first("__row").alias("__row")).select("__row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
