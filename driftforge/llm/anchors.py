"""Exact repeats across documents, found without comparing documents.

A window of `width` tokens is removed from a document if the same window starts in a document with a smaller id.
Every window names one of its own k-grams, the one with the least hash (winnowing): equal windows name equal
k-grams at equal places. So it is enough to
  1. pack the named k-grams ("anchors") of a batch of documents into one blob for each bucket of hashes,
  2. tell, for each bucket, which anchors two documents share, and send the shared ones back to their documents,
  3. cut the stretch of text for which a shared anchor speaks (a snippet) and bring equal anchors together,
  4. let a shard operator (suffix array, suffix automaton) find the equal windows of the shard's distinct snippets.
Anchors that a batch already holds twice, and snippets that it already holds for a smaller document, are settled in
the batch. So a passage that a third of all documents share costs one row for each batch, not for each document.
Where such a passage ends, an anchor has as many different snippets as documents. Anchors with HOT snippets or more are
therefore taken apart: the windows for which they speak are told shared or not as anchors were (steps 1 and 2 with
hashes of whole windows), and only shared windows move on, each under a key of its own. No key has more than about HOT
rows then, or one row for each batch.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from driftforge.llm.common import arrow_rows, blobs, cut, drop, ints, keyed, pow2, small_batches

#: Tokens that are hashed at once; longer documents are hashed in overlapping pieces.
CHUNK = 1 << 19
PIECE = 1 << 22
#: Different snippets from which an anchor is hot.
HOT = 1 << 16
#: Marks a hot anchor; anchors have 32 bits and those of the bucket.
_MARK = np.uint64(1 << 63)
#: Rows of one anchor at which a shard lets go of those that are settled.
COMPACT = 65_536
#: Set in an entry that stands for several documents of a batch; the other bits count their different snippets.
_SEVERAL = np.uint32(1 << 31)
_LO = np.uint64((1 << 24) - 1)
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


@dataclass(frozen=True)
class Plan:
    """tokens: text bytes -> uint64 array. cutter: text bytes -> a function that gives the bytes of tokens lo to hi."""

    tokens: Callable
    cutter: Callable
    width: int
    k: int
    docs_per_bucket: int = 1024
    hot: int = HOT


def gram_hashes(t: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive tokens, by doubling."""
    have, size = None, 0
    cur, width, need = (t + np.uint64(1)) * _MUL[0], 1, k
    cur ^= cur >> np.uint64(29)
    while True:
        if need & 1:
            if have is None:
                have, size = cur, width
            else:
                n = len(cur) - size
                have, size = (have[:n] * _MUL[1]) ^ cur[size:], size + width
        need >>= 1
        if not need:
            break
        nxt = cur[:-width] * _MUL[2]
        nxt ^= nxt >> np.uint64(31)
        nxt += cur[width:]
        cur, width = nxt, 2 * width
    have = have ^ (have >> np.uint64(32))
    have *= _MUL[0]
    return have ^ (have >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: -(w - width)], x[w - width :]) if w > width else x


def anchors(pieces: list[tuple[int, int, np.ndarray]], width: int, k: int) -> tuple[np.ndarray, ...]:
    """pieces: (document, first token's place, tokens).

    For each anchor: document, hash, first and last window start, and a hash of the snippet's two ends.
    """
    pieces = [p for p in pieces if len(p[2]) >= width]
    if not pieces:
        return tuple(np.empty(0, d) for d in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    lens = np.array([len(p[2]) for p in pieces])
    t = np.concatenate([p[2] for p in pieces])
    h = gram_hashes(t, k)
    key = (h & ~_LO) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(key, width - k + 1) & _LO).astype(np.int32)
    ends = np.cumsum(lens)
    ok = np.ones(len(t), bool)
    for e in ends:
        ok[e - width + 1 : e] = False
    s = np.flatnonzero(ok)
    at = at[s]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    piece = np.searchsorted(ends, s[first], "right")
    shift = np.array([p[1] for p in pieces])[piece] - (ends - lens)[piece]
    ends_hash = h[s[first]] * _MUL[1] ^ h[s[last] + width - k]
    return np.array([p[0] for p in pieces], np.int64)[piece], h[at[first]], s[first] + shift, s[last] + shift, ends_hash


def scan(texts: list[bytes], plan: Plan) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors() of all texts, a chunk at a time; a document's anchors are in ascending order."""
    held, size = [], 0
    for i, x in enumerate(texts):
        if len(x) < plan.width:
            continue
        t = plan.tokens(x)
        for at in range(0, max(1, len(t) - plan.width + 1), PIECE):
            held.append((i, at, t[at : at + PIECE + plan.width - 1]))
            size += len(held[-1][2])
            if size >= CHUNK:
                yield anchors(held, plan.width, plan.k)
                held, size = [], 0
    if held:
        yield anchors(held, plan.width, plan.k)


def _pack(batch: pa.RecordBatch, plan: Plan, bits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    got = list(scan(blobs(batch, "text"), plan))
    if got:
        doc, h, _, _, ends = (np.concatenate(x) for x in zip(*got, strict=True))
        yield from _packed(ints(batch, "did"), ints(batch, "rk"), doc, h >> np.uint64(32 - bits), ends, bits, schema)


def _packed(did: np.ndarray, rk: np.ndarray, doc: np.ndarray, pre: np.ndarray, what: np.ndarray, bits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one batch: its documents and what they hold (pre), bucket by bucket; `what` tells snippets apart."""
    if not len(doc):
        return
    # rows that repeat an id count as one document here
    same = np.unique(did, return_inverse=True)[1]
    order = np.lexsort((doc, pre))
    doc, pre, what = doc[order], pre[order], what[order]
    keep = np.concatenate(([True], (pre[1:] != pre[:-1]) | (doc[1:] != doc[:-1])))
    doc, pre, what = doc[keep], pre[keep], what[keep]
    start = np.flatnonzero(np.concatenate(([True], pre[1:] != pre[:-1])))
    n = np.diff(np.concatenate((start, [len(pre)])))
    low, high = np.minimum.reduceat(same[doc], start), np.maximum.reduceat(same[doc], start)
    multi = low != high
    known = np.repeat(multi, n)
    group = np.repeat(np.arange(len(n)), n)[known]
    order = np.lexsort((what[known], group))
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (what[known][order][1:] != what[known][order][:-1])))[: len(group)]
    different = np.bincount(group[new], minlength=len(n)).astype(np.uint32)
    bid = xxh64_intdigest(did.tobytes() + rk.tobytes()) >> 1
    out: dict[str, list] = {f.name: [] for f in schema}

    def row(bucket: int, kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        for name, v in zip(out, (bucket, bid, kind, a.tobytes(), b.tobytes(), c.tobytes()), strict=True):
            out[name].append(v)

    row(bid % (1 << bits), 1, np.stack((did, rk)), doc[known].astype(np.uint32), pre[known])
    # an entry for each anchor and document; one for all documents where the batch knows already that they share it
    first = np.zeros(len(pre), bool)
    first[start] = True
    take = ~known | first
    e_doc, e_pre = np.where(known, _SEVERAL | np.repeat(different, n), doc.astype(np.uint32))[take], pre[take]
    bucket = (e_pre >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for lo, hi in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        row(int(bucket[lo]), 0, np.empty(0, np.int64), e_doc[lo:hi], (e_pre[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    yield from arrow_rows(out, schema)


def _hot_windows(x: bytes, lo: np.ndarray, hi: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows in ranges of window starts of a text."""
    t = plan.tokens(x)
    spans = [(v >> 32, v & 0xFFFFFFFF) for v in _spans(lo, hi).tolist()]
    return np.concatenate([np.arange(a, b + 1) for a, b in spans]), np.concatenate([gram_hashes(t[a : b + plan.width], plan.width) for a, b in spans])


def _shared_lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    parts = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return [np.unique(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(y, np.uint64) for y in x or ())])) for x in parts]


def _documents(doc: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal documents."""
    edges = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else []
    yield from zip(edges, [*edges[1:], len(doc)], strict=True) if len(doc) else ()


def _pack_windows(batch: pa.RecordBatch, plan: Plan, bits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """As _pack, of the windows of hot anchors."""
    texts = blobs(batch, "text")
    hot_of = [x[x >= _MARK] ^ _MARK for x in _shared_lists(batch, "shared")]
    docs, found = [], []
    for doc, h, lo, hi, _ in scan(texts, plan):
        pre = h >> np.uint64(32 - bits)
        for a, b in _documents(doc):
            hot = np.isin(pre[a:b], hot_of[doc[a]])
            if hot.any():
                _, w = _hot_windows(texts[doc[a]], lo[a:b][hot], hi[a:b][hot], plan)
                found.append(np.unique(w >> np.uint64(32 - bits)))
                docs.append(np.full(len(found[-1]), doc[a]))
    if found:
        doc, pre = np.concatenate(docs), np.concatenate(found)
        yield from _packed(ints(batch, "did"), ints(batch, "rk"), doc, pre, pre, bits, schema)


def _shared(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """Of one bucket: the entries of each batch whose anchor another batch, or the batch itself, holds too.

    Kind 2: a batch's hot anchors.
    """
    own = pdf[pdf.kind == 1]
    rest = pdf[pdf.kind == 0]
    rows = [own[["bid", "kind", "a", "b", "c"]]]
    if len(rest):
        bucket = int(pdf.bucket.iloc[0])
        docs = [np.frombuffer(x, np.uint32) for x in rest.b]
        pre = [np.frombuffer(x, np.uint32) for x in rest.c]
        several = [d >= _SEVERAL for d in docs]
        every = np.concatenate(pre)
        weight = np.concatenate([np.where(x, d ^ _SEVERAL, 1) for x, d in zip(several, docs, strict=True)])
        values, at, count = np.unique(every, return_inverse=True, return_counts=True)
        snippets = np.bincount(at, weight)
        # a batch holds an anchor of one document alone in one entry, or of one document's rows in several
        batch = np.repeat(np.arange(len(pre)), [len(x) for x in pre])
        order = np.lexsort((batch, every))
        again = (every[order][1:] == every[order][:-1]) & (batch[order][1:] == batch[order][:-1])
        count -= np.bincount(at[order[1:]][again], minlength=len(values))
        common = np.union1d(values[count > 1], np.concatenate([p[x] for p, x in zip(pre, several, strict=True)]))
        b, c = [], []
        for p, d, x in zip(pre, docs, several, strict=True):
            i = np.minimum(np.searchsorted(common, p), max(0, len(common) - 1))
            hit = (common[i] == p) & ~x if len(common) else np.zeros(len(p), bool)
            b.append(d[hit].tobytes())
            c.append((p[hit].astype(np.uint64) | np.uint64(bucket << 32)).tobytes())
        rows.append(pd.DataFrame({"bid": rest.bid.to_numpy(), "kind": 0, "a": [b""] * len(rest), "b": b, "c": c}))
        hot = values[snippets >= most]
        if len(hot):
            c = [(np.unique(x[np.isin(x, hot)]).astype(np.uint64) | np.uint64(bucket << 32)).tobytes() for x in pre]
            rows.append(pd.DataFrame({"bid": rest.bid.to_numpy(), "kind": 2, "a": [b""] * len(rest), "b": [b""] * len(rest), "c": c}))
    return pd.concat(rows)


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one batch: the shared anchors of each document, hot ones with _MARK."""
    ids = np.frombuffer(pdf[pdf.kind == 1].a.iloc[0], np.int64).reshape(2, -1)
    hot = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in pdf[pdf.kind == 2].c)])
    pdf = pdf[pdf.kind < 2]
    doc = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf.b])
    pre = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf.c])
    pre = np.where(np.isin(pre, hot), pre | _MARK, pre)
    order = np.lexsort((pre, doc))
    doc, pre = doc[order], pre[order]
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, np.int64)
    parts = np.split(pre, start[1:]) if len(doc) else []
    return pd.DataFrame({"did": ids[0][doc[start]], "rk": ids[1][doc[start]], "shared": [x.tobytes() for x in parts], "hot": [bool((x >= _MARK).any()) for x in parts]})


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Inclusive ranges of window starts as longs, first << 32 | last, neighbours merged."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > top[:-1] + 1)))
    last = np.concatenate((first[1:], [len(lo)])) - 1
    return lo[first] << 32 | top[last]


def _snippets(batch: pa.RecordBatch, plan: Plan, bits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    did, rk, texts = ints(batch, "did").tolist(), ints(batch, "rk").tolist(), blobs(batch, "text")
    shared, windows = _shared_lists(batch, "shared"), _shared_lists(batch, "windows")
    hot_of = [x[x >= _MARK] ^ _MARK for x in shared]
    shared = [np.unique(x & ~_MARK) if len(y) else x for x, y in zip(shared, hot_of, strict=True)]
    found: dict[tuple[int, bytes], list] = {}
    for doc, h, lo, hi, _ in scan(texts, plan):
        pre = h >> np.uint64(32 - bits)
        for a, b in _documents(doc):
            d, s, p = int(doc[a]), shared[doc[a]], pre[a:b]
            hit = s[np.minimum(np.searchsorted(s, p), len(s) - 1)] == p
            cut = plan.cutter(texts[d])
            if len(hot_of[d]):
                hot = np.isin(p, hot_of[d])
                hit &= ~hot
                if hot.any():
                    at, w = _hot_windows(texts[d], lo[a:b][hot], hi[a:b][hot], plan)
                    told = np.isin(w >> np.uint64(32 - bits), windows[d])
                    for x, f in zip(w[told].view(np.int64).tolist(), at[told].tolist(), strict=True):
                        found.setdefault((x, cut(f, f + plan.width)), []).append((d, f, f))
            for x, f, t in zip(h[a:b][hit].view(np.int64).tolist(), lo[a:b][hit].tolist(), hi[a:b][hit].tolist(), strict=True):
                found.setdefault((x, cut(f, t + plan.width)), []).append((d, f, t))
    rows: list[tuple] = []
    settled: dict[int, list] = {}
    for (x, snippet), where in found.items():
        least = min(did[d] for d, _, _ in where)
        own: dict[int, list[int]] = {}  # a text that repeats itself holds a snippet many times, in one row
        for d, f, t in where:
            if did[d] > least:
                settled.setdefault(d, []).append((f, t))
            else:
                own.setdefault(d, []).append(f << 32 | t)
        rows += [(x, snippet, did[d], rk[d], array("q", at).tobytes(), False) for d, at in own.items()]
    for d, ranges in settled.items():
        a = np.array(ranges, np.int64)
        # a key of its own: copies have equal rk
        rows.append((xxh64_intdigest(did[d].to_bytes(8, "little", signed=True), rk[d] & 0xFFFFFFFF) - (1 << 63), b"", did[d], rk[d], _spans(a[:, 0], a[:, 1]).tobytes(), True))
    for at in range(0, len(rows), 20_000):
        yield from arrow_rows(dict(zip(schema.names, zip(*rows[at : at + 20_000], strict=True), strict=True)), schema)


def _flat(rows: pa.Table) -> pa.RecordBatch:
    """did, rk, span of all the ranges that rows hold packed in `at`."""
    at = rows.column("at").combine_chunks()
    at = at.chunk(0) if isinstance(at, pa.ChunkedArray) else at
    ends = np.frombuffer(at.buffers()[1], np.int32)[at.offset : at.offset + len(at) + 1]
    n = np.diff(ends) // 8
    spans = np.frombuffer(at.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.int64)
    return _said(np.repeat(rows.column("did").to_numpy(), n), np.repeat(rows.column("rk").to_numpy(), n), spans)


class _Shards:
    """Whole anchors of one task go in, (did, rk, span) come out."""

    def __init__(self, repeated: Callable, shard: int) -> None:
        self.repeated, self.shard = repeated, shard
        self.snippets: list[bytes] = []
        self.documents: list[int] = []
        self.rows: list[tuple[int, int, bytes]] = []  # snippet's number, rk, its places
        self.size = 0

    def take(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        done = rows.column("done").to_numpy()
        if done.any():
            yield _flat(rows.filter(pa.array(done)))
            rows = rows.filter(pa.array(~done))
        if not rows.num_rows:
            return
        h, did, rk = (rows.column(c).to_numpy() for c in ("h", "did", "rk"))
        text = rows.column("snippet").combine_chunks()
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new = new_h.copy()
        new[1:] |= pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        later = did > did[first][run]
        if later.any():  # the whole snippet is in a smaller document
            yield _flat(rows.filter(pa.array(later)))
        # only where an anchor has two different snippets can they share a window
        anchor = np.cumsum(new_h)[first]
        many = np.bincount(anchor)[anchor] > 1
        number = np.cumsum(many) - 1 + len(self.snippets)
        keep = ~later & many[run]
        self.rows += zip(number[run[keep]].tolist(), rk[keep].tolist(), rows.column("at").filter(pa.array(keep)).to_pylist(), strict=True)
        more = text.take(pa.array(first[many])).to_pylist()
        self.snippets += more
        self.documents += did[first[many]].tolist()
        self.size += sum(map(len, more)) + len(more)
        if self.size >= self.shard:
            yield from self.settle()

    def settle(self) -> Iterator[pa.RecordBatch]:
        found = self.repeated(self.snippets, self.documents)
        out: list[tuple] = []
        for i, rk, at in self.rows:
            if len(found[i]):
                lo = (np.frombuffer(at, np.int64)[:, None] >> 32) + found[i]
                out += [(self.documents[i], rk, x) for x in _spans(lo.ravel(), lo.ravel()).tolist()]
        self.snippets, self.documents, self.rows, self.size = [], [], [], 0
        if out:
            yield _said(*(np.array(x, np.int64) for x in zip(*out, strict=True)))


def _said(did: np.ndarray, rk: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(did), pa.array(rk), pa.array(span)], names=["did", "rk", "span"])


def _compact(rows: pa.Table) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    """Of one anchor: what is already known to be removed, and the rows that are still needed."""
    did = rows.column("did").to_numpy()
    text = rows.column("snippet").combine_chunks()
    new = np.ones(len(did), bool)
    new[1:] = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
    later = (did > did[np.flatnonzero(new)][np.cumsum(new) - 1]) & ~rows.column("done").to_numpy()
    said = [_flat(rows.filter(pa.array(later)))] if later.any() else []
    return said, rows.filter(pa.array(~later)).combine_chunks().to_batches()


def _settle(batches: Iterator[pa.RecordBatch], repeated: Callable, shard: int) -> Iterator[pa.RecordBatch]:
    """Rows come in ascending (anchor, snippet, document)."""
    shards = _Shards(repeated, shard)
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        h = ints(batch, "h")
        if h[0] == h[-1]:
            if size >= COMPACT and ints(held[0], "h")[0] == h[0]:
                said, rest = _compact(pa.Table.from_batches(held))
                yield from said
                held, size = rest, 0
            continue
        if size < 8192:
            continue
        at = int(np.searchsorted(h, h[-1]))
        yield from shards.take(pa.Table.from_batches([*held[:-1], batch.slice(0, at)]))
        held, size = [batch.slice(at)], batch.num_rows - at
    if held:
        yield from shards.take(pa.Table.from_batches(held))
    yield from shards.settle()


def repeated_windows(docs: DataFrame, plan: Plan, repeated: Callable, shard: int) -> DataFrame:
    """(did, rk, spans): for documents with removed windows, inclusive ranges of window starts, first << 32 | last."""
    spark = docs.sparkSession
    small_batches(spark)
    text = keyed(docs).select("did", "rk", "text")
    bits = pow2(docs.count() / plan.docs_per_bucket, 16).bit_length() - 1
    packed_schema = pa.schema([("bucket", pa.int64()), ("bid", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])

    def told(rows: DataFrame, pack: Callable, hot: float) -> DataFrame:
        packed = rows.mapInArrow(lambda it: (y for x in it for y in pack(x, plan, bits, packed_schema)), "bucket long, bid long, kind int, a binary, b binary, c binary")
        said = packed.groupBy("bucket").applyInPandas(lambda pdf: _shared(pdf, hot), "bid long, kind int, a binary, b binary, c binary")
        return said.groupBy("bid").applyInPandas(_by_document, "did long, rk long, shared binary, hot boolean").groupBy("did", "rk").agg(F.collect_list("shared").alias("shared"), F.max("hot").alias("hot"))

    lists = cut(told(text, _pack, plan.hot), "anchors")
    done = [lists]
    none = F.lit(None).cast("array<binary>")
    hot = lists.where("hot")
    if hot.isEmpty():
        lists = lists.withColumn("windows", none)
    else:
        split = cut(told(text.join(hot, ["did", "rk"]), _pack_windows, float("inf")), "windows")
        done.append(split)
        lists = lists.join(split.select("did", "rk", F.col("shared").alias("windows")), ["did", "rk"], "left")
    snippet_schema = pa.schema([("h", pa.int64()), ("snippet", pa.binary()), ("did", pa.int64()), ("rk", pa.int64()), ("at", pa.binary()), ("done", pa.bool_())])
    found = text.join(lists, ["did", "rk"]).mapInArrow(lambda it: (y for x in it for y in _snippets(x, plan, bits, snippet_schema)), "h long, snippet binary, did long, rk long, at binary, done boolean")
    settled = found.repartition("h").sortWithinPartitions("h", "snippet", "did").mapInArrow(lambda it: _settle(it, repeated, shard), "did long, rk long, span long")
    spans = cut(settled, "spans")
    for made in done:
        drop(made)
    return spans.groupBy("did", "rk").agg(F.collect_list("span").alias("spans"))


def span_lists(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    col = batch.column(batch.schema.get_field_index("spans"))
    values, at, there = col.values.to_numpy(), col.offsets.to_numpy(), col.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if v else None for a, b, v in zip(at[:-1], at[1:], there, strict=True)]


def covered(spans: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n tokens a removed window covers."""
    enter = np.bincount(spans >> 32, minlength=n + 1)
    leave = np.bincount(np.minimum((spans & 0xFFFFFFFF) + width, n), minlength=n + 1)
    return np.cumsum(enter[:n] - leave[:n]) > 0
