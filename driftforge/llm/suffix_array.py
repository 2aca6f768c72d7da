"""Operator 6: exact substring removal through suffix arrays that are built by induced sorting.

The arrays are built for shards: anchors (see anchors.py) bring all snippets that can hold a common window to one
shard, and the shard's text is the concatenation of its distinct snippets. Suffixes are classified, their
leftmost-smaller substrings sorted by induction, named, and sorted recursively; the whole order is then induced.
The scans read blocks of places, each up to the first place that the block itself fills. At every depth of the
recursion the same induction sorts; permuted common prefixes come from irreducible ones.

Edge cases: null text is empty; very long texts are hashed in pieces that overlap by a window; documents shorter than a window keep everything; a window that repeats only inside
its own document, or only in rows of the same doc_id, stays; null doc_id counts as the largest id and stays null;
identical rows get identical results; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftforge.llm.anchors import Plan, covered, repeated_windows, span_lists
from driftforge.llm.common import arrow_rows, blobs, ints, keyed, table

WIDTH = 50
#: Bytes of distinct snippets in a shard.
SHARD = 3 << 19


def _scan(sa: np.ndarray, t: np.ndarray, wanted: np.ndarray, edge: np.ndarray, step: int) -> None:
    """One induction over the places of sa: left to right (step 1, larger types) or right to left (step -1, smaller).

    The suffix at a place puts the one before it, if that is wanted, at the edge of its bucket, always further on. So a
    block of places can be read at once up to the first place that the block itself fills; the next block starts there.
    """
    n, at, block, place = len(t), 0, 1024, np.arange(1 << 16)
    view = sa if step == 1 else sa[::-1]
    while at < n:
        stop = min(n, at + block)
        seg = view[at:stop]
        src = (seg > 0).nonzero()[0]
        j = seg[src]
        j -= 1
        keep = wanted[j]
        src, j = src[keep], j[keep]
        block = min(2 * block, 1 << 16)
        if len(j):
            ch = t[j]
            order = ch.argsort(kind="stable")
            ch = ch[order]
            # the edge of the bucket, and beyond it the suffixes of the same block and symbol
            to = edge[ch] + place[: len(ch)] - ch.searchsorted(ch)
            first = int(to.min())
            if first < stop:
                stop = first
                ready = src[order] < first - at
                order, ch, to = order[ready], ch[ready], to[ready]
                block = min(block, max(64, 2 * (stop - at)))
            view[to] = j[order]
            edge[ch] = to + 1  # of equal symbols the last stands
        at = stop


def _induce(t: np.ndarray, small: np.ndarray, heads: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones, which come in order: first the larger types, then the smaller."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    order = t[lms].argsort(kind="stable")
    ch = t[lms][order]
    sa[ends[ch] + np.arange(len(ch)) - ch.searchsorted(ch, "right")] = lms[order]
    _scan(sa, t, ~small, heads.copy(), 1)
    sa[(sa >= 0) & small[sa]] = -1  # the seeds; all smaller types come again, from the larger ones
    _scan(sa, t, small, n - ends, -1)
    sa[0] = n - 1  # the sentinel precedes all
    return sa


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Of t, whose last symbol is 0 and occurs nowhere else; symbols: one more than the largest."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    eq = np.concatenate((t[:-1] == t[1:], [False]))
    less = np.concatenate((t[:-1] < t[1:], [True]))
    run_end = np.where(eq, n, np.arange(n))
    small = less[np.minimum.accumulate(run_end[::-1])[::-1]]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    count = np.bincount(t, minlength=symbols)
    ends = np.cumsum(count)
    heads = ends - count
    sa = _induce(t, small, heads, ends, lms)
    # name the leftmost-smaller substrings in their induced order
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.concatenate((lms, [n]))) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    open_, off = np.flatnonzero(same), 0
    while len(open_):
        x, y = a[open_] + off, b[open_] + off
        hit = (y < n) & (x < n)
        hit[hit] = t[x[hit]] == t[y[hit]]
        same[open_[~hit]] = False
        off += 1
        open_ = open_[hit & (length[a[open_]] > off)]
    name = np.cumsum(np.concatenate(([0], ~same)))
    if name[-1] + 1 < len(lms):
        named = np.zeros(n, np.int64)
        named[order] = name
        order = lms[suffix_array(named[lms], int(name[-1]) + 1)]
    return _induce(t, small, heads, ends, order)


def common_prefixes(data: np.ndarray, sa: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Permuted longest common prefixes: for each place of data, how far its suffix agrees with the one before it in sa.

    Only irreducible values are compared, those whose suffix and neighbour follow different bytes; any other is one less
    than the value a place before. rest: bytes left in each place's snippet, which no value exceeds.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.flatnonzero(before >= 0)
    left = np.concatenate(([-1], data[:-1].astype(np.int64)))
    irreducible = np.ones(n, bool)
    k = own[(own > 0) & (before[own] > 0)]
    # a snippet's first place is always compared: no value reaches into the next snippet
    irreducible[k] = (left[k] != left[before[k]]) | (rest[k - 1] == 0) | (rest[before[k] - 1] == 0)
    most = int(rest.max(initial=0)) + 8
    padded = np.concatenate((data, np.zeros(most + 8, np.uint8)))
    words = np.ndarray((n + most,), "<u8", buffer=padded, strides=(1,))
    plcp = np.zeros(n, np.int64)
    open_, off = own[irreducible[own]], 0
    while len(open_):
        x = words[open_ + off] ^ words[before[open_] + off]
        same = x == 0
        low = x[~same] & (~x[~same] + np.uint64(1))
        plcp[open_[~same]] = off + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        off += 8
        open_ = open_[same]
        over = rest[open_] <= off
        plcp[open_[over]] = off
        open_ = open_[~over]
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    plcp = plcp[last] - (np.arange(n) - last)
    return np.where(before >= 0, np.minimum(np.minimum(plcp, rest), rest[np.maximum(before, 0)]), 0)


def repeated(snippets: list[bytes], documents: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each snippet, the starts of its windows that also start in a snippet of a smaller document."""
    if not snippets:
        return []
    lens = np.array([len(s) for s in snippets])
    data = np.frombuffer(b"\x00".join(snippets) + b"\x00", np.uint8)
    begin = np.cumsum(lens + 1) - lens - 1
    t = data.astype(np.int64) + 2
    t[begin + lens] = 1
    sa = suffix_array(np.concatenate((t, [0])), 258)[1:]
    owner = np.repeat(np.arange(len(lens)), lens + 1)
    rest = (begin + lens)[owner] - np.arange(len(data))
    # windows that are equal lie side by side: nothing shorter sorts between them
    order = sa[rest[sa] >= width]
    if not len(order):
        return [np.empty(0, np.int64)] * len(lens)
    head = np.flatnonzero(np.concatenate(([True], common_prefixes(data, sa, rest)[order[1:]] < width)))
    doc = np.array(documents, np.int64)[owner[order]]
    least = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.concatenate((head, [len(order)]))))
    gone = np.sort(order[doc > least])
    cut = np.searchsorted(gone, np.concatenate((begin, [len(data)])))
    return [gone[a:b] - s for a, b, s in zip(cut, cut[1:], begin, strict=False)]


PLAN = Plan(lambda x: np.frombuffer(x, np.uint8).astype(np.uint64), lambda x: lambda lo, hi: x[lo:hi], WIDTH, 20)


def removals(docs: DataFrame) -> DataFrame:
    """(did, rk, spans): see anchors.repeated_windows."""
    return repeated_windows(docs, PLAN, repeated, SHARD)


def _cut(it: Iterator[pa.RecordBatch], schema: pa.Schema, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out: dict[str, list] = {f.name: [] for f in schema}
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        for d, x, r in zip(ids, blobs(batch, "text"), span_lists(batch), strict=True):
            n, spans, kept = len(x), 0, x
            if r is not None:
                gone = covered(r, n, WIDTH)
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
            row = {"doc_id": d, "n_bytes": n, "n_removed": n - len(kept), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}
            if texts:
                row["kept"] = kept.decode("utf-8", "ignore")
            for name in out:
                out[name].append(row[name])
        if texts and batch.num_rows:
            rest = batch.column(batch.schema.get_field_index("__rest"))
            columns = [pa.array(out[f.name], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*columns, rest], names=[*schema.names, "__rest"])
        else:
            yield from arrow_rows(out, schema)


def substring_removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (text; a character that a cut halves goes)."""
    return _apply(docs.select("doc_id", "text"), True).drop("__rest")


def _apply(docs: DataFrame, texts: bool) -> DataFrame:
    """texts: also the kept text, and as `__rest` a struct of all columns but the text."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    made = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rest = []
    if texts:
        fields.append(("kept", pa.string()))
        rest = [F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "text"]).alias("__rest")]
        made = made.add("kept", "string").add("__rest", docs.select(*rest).schema["__rest"].dataType)
    schema = pa.schema(fields)
    rows = keyed(docs, *rest)
    return rows.join(removals(docs), ["did", "rk"], "left").mapInArrow(lambda it: _cut(it, schema, texts), made)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the repeated bytes; a document of which nothing is left goes.

    Null texts become empty and stay; an empty table stays empty.
    """
    kept = _apply(docs, True).where("n_bytes = 0 or n_bytes > n_removed")
    cols = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return kept.select(*[cols.get(c, F.col("`__rest`.`" + c.replace("`", "``") + "`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply(table(spark, sf_dir, "documents"), False)


QUERIES = {"op6_suffix_array_dedup": op6_suffix_array_dedup}
