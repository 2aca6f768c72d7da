"""Operator 3: a content-addressed store of token ids.

Ids are cut into chunks where a rolling hash of 16 ids says so, so equal passages give equal chunks wherever they stand.
No cut is nearer than LEAST ids to the one before, so a word or line said over and over makes no chunk a saying.
A chunk is addressed by a digest of its bytes and stored once, with the first row that has it. The store is three tables:

  documents   in ascending doc_id order, in parts of about PART ids (rows are dealt by the ids before them, so parts
              are even however doc_ids are spread):
              part, start, n_tokens   place in the whole id stream
              recipe                  16-byte digests of the chunks, in order; sizes: ids in each, 32-bit
              owned                   a byte for each chunk: 1 if its ids are in this row's payload, 2 if other rows use them too
              payload                 the owned chunks' ids, little-endian 16-bit
              root                    Merkle root over the recipe's digests
  manifest    of each part: first start, documents, ids, and the Merkle root over its rows in order
  root        documents, ids and the Merkle root over the parts, checked at writing against the sums of the input

Reading checks the manifest against the root, every part against the manifest, every recipe against its root and every
payload against its digests: a lost, added or altered file, row or chunk is an error. A document that holds all its
chunks gets its crc32 from its ids at once. For others it is put together from their chunks' values, so chunks of other
documents cross the network as digests and sums, not as ids; what several rows lack alike is asked for once.

Edge cases: null text is empty: one id, the end; null doc_id sorts last and stays null; rows that repeat a doc_id are
documents of their own, in the order of their hashes; identical rows share all chunks but have their own starts; a very
long text is one row of many chunks; an empty table gives an empty store; other columns are left alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftforge.llm.anchors import gram_hashes
from driftforge.llm.common import CLEANUP, arrow_rows, blobs, cut, drop, ints, keyed, new_path, settings, small_batches, table
from driftforge.llm.encode import encoder

END = 2
ROLL = 16
#: Ids of a chunk on average (a power of two; of what follows the least), at most and at least (but for a row's last).
MEAN, MOST, LEAST = 256, 2048, 32
#: In `owned`.
OWN, SHARED = 1, 2
#: Ids of a part, unless that makes more than PARTS of them.
PART, PARTS = 1 << 23, 1 << 20


def digest(x: bytes) -> bytes:
    return blake2b(x, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


class Merkle:
    """merkle() of leaves that come one by one, in memory that grows with their logarithm."""

    def __init__(self) -> None:
        self.peaks: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for i, peak in enumerate(self.peaks):
            if peak is None:
                self.peaks[i] = leaf
                return
            leaf, self.peaks[i] = digest(peak + leaf), None
        self.peaks.append(leaf)

    def root(self) -> bytes:
        odd = None  # the last node of a level that has no partner yet, hashed alone to go up
        for i, peak in enumerate(self.peaks):
            if peak is not None and odd is not None:
                odd = digest(peak + odd)
            elif peak is not None:
                odd = peak if i + 1 == len(self.peaks) else digest(peak)
            elif odd is not None:
                odd = digest(odd)
        return digest(b"") if odd is None else odd


def _spaced(at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of the cuts (ascending; begin: where each one's stream begins) those that are LEAST ids from the last that is kept."""
    if not (at - np.maximum(begin, np.concatenate(([0], at[:-1]))) < LEAST).any():
        return at
    kept, last = [], 0
    for x, b in zip(at.tolist(), begin.tolist(), strict=True):
        if x - max(last, b) >= LEAST:
            kept.append(x)
            last = x
    return np.array(kept, np.int64)


def chunk_ends(streams: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each stream of 16-bit ids, streams hashed side by side."""
    n = np.array([len(x) // 2 for x in streams], np.int64)
    stop = np.cumsum(n)
    ids = np.frombuffer(b"".join(streams), "<u2")
    at = np.empty(0, np.int64)
    if len(ids) > ROLL:
        at = np.flatnonzero((gram_hashes(ids.astype(np.uint64), ROLL) & np.uint64(MEAN - 1)) == 0) + ROLL
        # the hashed ids belong to one stream
        of = np.searchsorted(stop, at - 1, "right")
        inside = at - ROLL >= (stop - n)[of]
        at = _spaced(at[inside], (stop - n)[of[inside]])
    ends = np.unique(np.concatenate((at, stop)))
    begin = np.concatenate(([0], ends[:-1]))
    if (ends - begin).max(initial=0) > MOST:
        ends = np.unique(np.concatenate([np.append(np.arange(b + MOST, e, MOST), e) for b, e in zip(begin, ends, strict=True)]))
    cut_ = np.searchsorted(ends, np.concatenate(([0], stop)), "right")
    return [(ends[a:b] - s).tolist() for a, b, s in zip(cut_[:-1], cut_[1:], stop - n, strict=True)]


# crc32 of joined pieces: each piece's value is carried over the zeros after it, a linear map of 32 bits


@cache
def _over(k: int) -> np.ndarray:
    """The map over 2**k zero bytes, as four tables of 256."""
    v = np.arange(256, dtype=np.uint32)
    if k == 0:
        first = v
        for _ in range(8):
            first = (first >> np.uint32(1)) ^ np.uint32(0xEDB88320) * (first & np.uint32(1))
        return np.stack([first, v, v << np.uint32(8), v << np.uint32(16)])
    return _carried(_over(k - 1), _over(k - 1))


def _carried(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


def crcs_join(values: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """crc32 of each run of pieces, from all pieces' crc32 and bytes in order; begin: the first piece of each run, which has one at least."""
    stop = np.cumsum(sizes, dtype=np.int64)
    end = np.append(begin[1:], len(sizes)) - 1
    after = np.repeat(stop[end], end + 1 - begin) - stop
    out = values.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        far = np.flatnonzero(after >> k & 1)
        out[far] = _carried(_over(k), out[far])
    return np.bitwise_xor.reduceat(out, begin) if len(begin) else out[:0]


def crc_join(parts: list[tuple[int, int]]) -> int:
    """parts: (crc32, bytes) in order."""
    return int(crcs_join(*np.array(parts, np.int64).T, np.zeros(1, np.int64))[0]) if parts else 0


def _wide(ids: bytes) -> bytes:
    """16-bit ids as 32-bit ids."""
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _encoded(docs: DataFrame, tokenizer: str | None) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("rk", pa.int64()), ("ids", pa.binary()), ("recipe", pa.binary()), ("sizes", pa.binary()), ("n_tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in it:
            out: dict[str, list] = {f.name: [] for f in schema}
            texts, keys = blobs(b, "text"), list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            made = enc.all_ids(texts)
            for at in range(0, len(texts), 64):
                raws = [x + END.to_bytes(2, "little") for x in islice(made, 64)]
                for (d, k, r), raw, ends in zip(keys[at : at + 64], raws, chunk_ends(raws), strict=True):
                    begin = [0, *ends[:-1]]
                    recipe = b"".join([digest(raw[2 * s : 2 * e]) for s, e in zip(begin, ends, strict=True)])
                    for name, v in zip(out, (d, k, r, raw, recipe, (np.array(ends) - begin).astype("<u4").tobytes(), len(raw) // 2), strict=True):
                        out[name].append(v)
            yield from arrow_rows(out, schema)

    small_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, "doc_id long, did long, rk long, ids binary, recipe binary, sizes binary, n_tokens long")


def _digests(recipe: str = "recipe", width: int = 16) -> F.Column:
    """recipe -> array of digests."""
    n = (F.octet_length(recipe) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(recipe), i * width + 1, width))


def with_starts(sizes: DataFrame) -> DataFrame:
    """did, rk, no, n_tokens -> did, rk, no, n_tokens, start: tokens of all rows before, in order of (did, rk, no).

    no tells rows apart. The sum runs inside ranges of rows; only a total for each range is summed over all.
    """
    placed = cut(sizes.repartitionByRange("did", "rk", "no").withColumn("range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("range").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy("did", "rk", "no").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return running.join(before, "range").select("did", "rk", "no", "n_tokens", (F.col("own") + F.col("before")).alias("start"))


_ROW = [("part", pa.int32()), ("did", pa.int64()), ("rk", pa.int64()), ("no", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("own", pa.list_(pa.binary())), ("shared", pa.list_(pa.binary())), ("ids", pa.binary()), ("recipe", pa.binary()), ("sizes", pa.binary())]
_ROW_DDL = "part int, did long, rk long, no long, doc_id long, start long, n_tokens long, own array<binary>, shared array<binary>, ids binary, recipe binary, sizes binary"


def _lists(column: pa.ListArray) -> list[list]:
    """to_pylist() of a column of lists, faster; null lists are empty."""
    values, at = column.values.to_pylist(), column.offsets.to_pylist()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _keys(rows: np.ndarray) -> np.ndarray:
    """Columns did, rk, no -> strings of 24 bytes in the same order."""
    return np.ascontiguousarray((rows.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").T).view("S24").ravel()


def _dealt(encoded: DataFrame, bounds: np.ndarray) -> DataFrame:
    """The encoded rows with their parts; bounds: did, rk and no of the first row of each part but the first."""
    shared = encoded.sparkSession.sparkContext.broadcast(_keys(bounds))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            part = np.searchsorted(shared.value, _keys(np.stack([ints(b, c) for c in ("did", "rk", "no")])), "right")
            new = {"start": pa.nulls(b.num_rows, pa.int64()), "own": (none := pa.nulls(b.num_rows, pa.list_(pa.binary()))), "shared": none, "part": pa.array(part, pa.int32())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(b.schema.get_field_index(n)) for n, _ in _ROW], schema=pa.schema(_ROW))

    return encoded.mapInArrow(run, _ROW_DDL)


def _fold(rows: DataFrame) -> DataFrame:
    """part, start, n_tokens, root -> of each part: part, start, documents, tokens, root."""
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64()), ("root", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, said = None, Merkle(), [0, 0, 0]
        for b in it:
            for part, start, n, root in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now:
                    if now is not None:
                        yield from arrow_rows(dict(zip(schema.names, [[now], *([x] for x in said), [tree.root()]], strict=True)), schema)
                    now, tree, said = part, Merkle(), [start, 0, 0]
                tree.add(digest(struct.pack("<qq", start, n) + root))
                said[1] += 1
                said[2] += n
        if now is not None:
            yield from arrow_rows(dict(zip(schema.names, [[now], *([x] for x in said), [tree.root()]], strict=True)), schema)

    light = rows.select("part", "start", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "start")
    return light.mapInArrow(run, "part int, start long, documents long, tokens long, root binary")


def _crown(manifest: DataFrame) -> tuple[int, int, bytes]:
    """documents, tokens and the Merkle root of all parts, which must join without gaps; one row a part passes the driver."""
    tree, documents, tokens = Merkle(), 0, 0
    for r in manifest.orderBy("part").toLocalIterator():
        if r.start != tokens:
            raise ValueError(f"part {r.part} starts at {r.start}, after {tokens} ids")
        tree.add(digest(struct.pack("<iqqq", r.part, r.start, r.documents, r.tokens) + bytes(r.root)))
        documents, tokens = documents + r.documents, tokens + r.tokens
    return documents, tokens, tree.root()


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, part: int = PART) -> None:
    """Writes path/documents, path/manifest and path/root."""
    spark = docs.sparkSession
    encoded = cut(_encoded(docs, tokenizer).withColumn("no", F.monotonically_increasing_id()), "encoded")
    light = encoded.select("did", "rk", "no", "n_tokens", "recipe")
    total = light.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    part = max(part, -(-total.t // PARTS))
    parts = max(1, -(-total.t // part))
    chunks = light.select("no", F.explode(_digests()).alias("digest"))
    # rows hear which of their chunks they own, and which of these other rows have too
    first = chunks.groupBy("digest").agg(F.min("no").alias("no"), F.max("no").alias("last"))
    owned = first.groupBy("no").agg(F.collect_list("digest").alias("own"), F.collect_list(F.when(F.col("last") > F.col("no"), F.col("digest"))).alias("shared"))
    kept = told = cut(with_starts(light.select("did", "rk", "no", "n_tokens")).join(owned, "no", "left").withColumn("part", F.floor(F.col("start") / part).cast("int")), "told")
    first = told.groupBy("part").agg(F.min(F.struct("did", "rk", "no")).alias("x")).orderBy("part").collect()  # at most PARTS rows
    bounds = np.array([[r.x.did, r.x.rk, r.x.no] for r in first[1:]], np.int64).reshape(-1, 3).T
    numbers = {r.part: k for k, r in enumerate(first)}  # a document longer than a part leaves numbers out
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("recipe", pa.binary()), ("sizes", pa.binary()), ("owned", pa.binary()), ("payload", pa.binary()), ("root", pa.binary())])

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told_of: dict[tuple, tuple] = {}
        for b in it:
            cols = {n: (_lists(c) if n in ("own", "shared") else c.to_pylist()) for n, c in zip(b.schema.names, b.columns, strict=True)}
            out: dict[str, list] = {f.name: [] for f in schema}
            for i, key in enumerate(zip(cols["did"], cols["rk"], cols["no"], strict=True)):
                if cols["start"][i] is not None:  # what a row is told comes just before it
                    told_of = {key: (cols["start"][i], cols["own"][i], cols["shared"][i], cols["part"][i])}
                    continue
                start, own, shared, at = told_of.pop(key)
                ids, recipe, sizes = cols["ids"][i], cols["recipe"][i], cols["sizes"][i]
                ends = 2 * np.cumsum(np.frombuffer(sizes, "<u4")).astype(np.int64)
                names = [recipe[k : k + 16] for k in range(0, len(recipe), 16)]
                mark = np.zeros(len(ends), np.uint8)
                if own:
                    place = dict(zip(reversed(names), range(len(names) - 1, -1, -1), strict=True))  # of equal chunks the first
                    mark[[place[x] for x in own]] = OWN
                    mark[[place[x] for x in shared]] = SHARED
                payload = ids if mark.all() else b"".join(ids[(ends[k - 1] if k else 0) : ends[k]] for k in np.flatnonzero(mark).tolist())
                root = merkle(names)
                for name, v in zip(out, (cols["doc_id"][i], at, start, cols["n_tokens"][i], recipe, sizes, mark.tobytes(), payload, root), strict=True):
                    out[name].append(v)
            yield from arrow_rows(out, schema)

    # the ids are shuffled once: rows and what they are told meet in their part, each next to the other in order
    if list(numbers) != list(numbers.values()):
        told = told.join(F.broadcast(spark.createDataFrame(list(numbers.items()), "part int, k int")), "part").drop("part").withColumnRenamed("k", "part")
    said = told.select("part", "did", "rk", "no", F.lit(None).cast("long").alias("doc_id"), "start", "n_tokens", "own", "shared", *[F.lit(None).cast("binary").alias(c) for c in ("ids", "recipe", "sizes")])
    rows = _dealt(encoded, bounds).union(said).repartitionById(max(1, len(numbers)), F.col("part"))
    rows = rows.sortWithinPartitions("did", "rk", "no", F.col("start").isNull())
    ddl = "doc_id long, part int, start long, n_tokens long, recipe binary, sizes binary, owned binary, payload binary, root binary"
    with settings(spark, {CLEANUP: "true"}):
        rows.mapInArrow(build, ddl).write.option("compression", "zstd").parquet(f"{path}/documents")
    drop(encoded)
    drop(kept)
    _fold(spark.read.parquet(f"{path}/documents")).write.parquet(f"{path}/manifest")
    documents, tokens, root = _crown(spark.read.parquet(f"{path}/manifest"))
    if (documents, tokens) != (total.n, total.t):
        raise ValueError(f"wrote {documents} documents and {tokens} ids of {total.n} and {total.t}")
    spark.createDataFrame([(documents, tokens, bytearray(root))], "documents long, tokens long, root binary").write.parquet(f"{path}/root")


def _against_manifest(spark: SparkSession, seen: DataFrame, path: str) -> None:
    """The rows that were read must be those of the manifest, and the manifest that of the root."""
    manifest = spark.read.schema("part int, start long, documents long, tokens long, root binary").parquet(f"{path}/manifest")
    kept = spark.read.parquet(f"{path}/root").first()
    if _crown(manifest) != (kept.documents, kept.tokens, bytes(kept.root)):
        raise ValueError("the manifest fails its root")
    found = _fold(seen)
    joined = manifest.alias("m").join(found.alias("f"), F.col("m.part") == F.col("f.part"), "full")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}")) for c in manifest.columns]
    bad = joined.where(~(same[0] & same[1] & same[2] & same[3] & same[4])).select(F.coalesce("m.part", "f.part").alias("part")).limit(5).collect()
    if bad:
        raise ValueError(f"parts {sorted(r.part for r in bad)} fail the manifest: documents were lost, added or changed")


def _verified(rows: DataFrame) -> DataFrame:
    """The rows of path/documents without their ids, once these have passed their checks."""
    # of rows that lack chunks: sizes and crcs (32-bit) of all chunks; slots: which of those it lacks each is, or -1; the
    # digests of these and a digest of them all. offers: digest, crc32 and size of each chunk that others use
    ddl = "doc_id long, part int, start long, n_tokens long, root binary, ids_crc32 long, sizes binary, crcs binary, slots binary, lacks binary, want binary, offers binary"
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("ids_crc32", pa.int64()), *[(c, pa.binary()) for c in ("sizes", "crcs", "slots", "lacks", "want", "offers")]])

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: dict[str, list] = {f.name: [] for f in schema}
            for d, p, start, n, recipe, sizes, owned, payload, root in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                names = [recipe[i : i + 16] for i in range(0, len(recipe), 16)]
                if merkle(names) != root:
                    raise ValueError(f"recipe of document {d} fails its root")
                counts, at = np.frombuffer(sizes, "<u4").tolist(), 0
                pieces: dict[bytes, bytes] = {}
                lacks: dict[bytes, int] = {}
                offers = []
                for name, size, own in zip(names, counts, owned, strict=True):
                    if own:
                        pieces[name] = piece = payload[at : at + 2 * size]
                        at += 2 * size
                        if digest(piece) != name:
                            raise ValueError(f"a chunk of document {d} fails its digest")
                        if own == SHARED:
                            offers.append(name + struct.pack("<II", zlib.crc32(_wide(piece)), size))
                    elif name not in pieces:
                        lacks.setdefault(name, len(lacks))
                    elif len(pieces[name]) != 2 * size:
                        raise ValueError(f"a chunk of document {d} fails its digest")
                if at != len(payload):
                    raise ValueError(f"document {d} holds more than its chunks")
                if sum(counts) != n:
                    raise ValueError(f"document {d} lacks chunks")
                if lacks:
                    known = {x: zlib.crc32(_wide(piece)) for x, piece in pieces.items()}
                    wanted = b"".join(lacks)
                    crc, rest = None, (sizes, np.array([known.get(x, 0) for x in names], "<u4").tobytes(), np.array([lacks.get(x, -1) for x in names], "<i4").tobytes(), wanted, digest(wanted))
                else:
                    ids = payload if len(pieces) == len(names) else b"".join([pieces[x] for x in names])
                    crc, rest = zlib.crc32(_wide(ids)), (None,) * 5
                for key, v in zip(out, (d, p, start, n, root, crc, *rest, b"".join(offers) or None), strict=True):
                    out[key].append(v)
            yield from arrow_rows(out, schema)

    return rows.select("doc_id", "part", "start", "n_tokens", "recipe", "sizes", "owned", "payload", "root").mapInArrow(verify, ddl)


def _asked(seen: DataFrame) -> DataFrame:
    """want, i, digest: the chunks of each list that some rows lack; a list that many lack is there once."""
    lists = seen.where("want is not null").groupBy("want").agg(F.first("lacks").alias("lacks"))
    return lists.select("want", F.posexplode(_digests("lacks")).alias("i", "digest"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files alone; whatever fails its check is an error."""

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in it:
            if not b.num_rows:
                continue
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            sizes, crcs, begin = [], [], []
            for d, size, crc, slot, got in zip(*(cols[n] for n in ("doc_id", "sizes", "crcs", "slots", "got")), strict=True):
                size, crc, slot = np.frombuffer(size, "<u4"), np.frombuffer(crc, "<u4").copy(), np.frombuffer(slot, "<i4")
                told = np.zeros((slot.max() + 1, 2), np.uint32)
                for x in got or ():
                    told[x["i"]] = struct.unpack("<II", x["offer"])
                mine = slot >= 0
                if len(got or ()) != len(told) or (told[slot[mine], 1] != size[mine]).any():
                    raise ValueError(f"document {d} lacks chunks")
                crc[mine] = told[slot[mine], 0]
                begin.append(len(size))
                sizes.append(size)
                crcs.append(crc)
            at = np.concatenate(([0], np.cumsum(begin)[:-1]))
            worth = crcs_join(np.concatenate(crcs), 4 * np.concatenate(sizes).astype(np.int64), at)
            yield from arrow_rows({n: cols[n] for n in ("doc_id", "start", "n_tokens")} | {"ids_crc32": worth.astype(np.int64)}, end)

    seen = cut(_verified(spark.read.parquet(f"{path}/documents")), "seen")
    _against_manifest(spark, seen, path)
    offered = seen.where("offers is not null").select(F.explode(_digests("offers", 24)).alias("x")).select(F.substring("x", 1, 16).alias("digest"), F.substring("x", 17, 8).alias("offer"))
    # written, so that the rows of a list that very many lack can be dealt out when they hear of it
    found = cut(_asked(seen).join(offered, "digest").groupBy("want").agg(F.collect_list(F.struct("i", "offer")).alias("got")), "found")
    heard = seen.where("want is not null").join(found, "want", "left").select("doc_id", "start", "n_tokens", "sizes", "crcs", "slots", "got").mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return seen.where("want is null").select("doc_id", "start", "n_tokens", "ids_crc32").union(heard)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)


QUERIES = {"op3_token_store": op3_token_store}
