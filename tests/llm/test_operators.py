"""The corpus operators against plain versions, on a small table with nulls, ties, copies and odd texts."""

import dataclasses
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from driftforge.llm import anchors, automaton, components, decontaminate, hosts, licences, packing, quality, registry, sharding, simhash, store, substring, suffix_array
from driftforge.llm.encode import Encoder

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = line(60), line(80)
    out = [None, "", " \n\t", "one", "one two", "ONE two", "a" * 3000, line(5000), passage, passage, base, base]
    out += [f"{line(20)} {passage} {line(20)}" for _ in range(12)]
    out += [base.replace(base.split()[k], "zz", 1) for k in range(12)]
    out += [line(rng.randint(3, 90)) for _ in range(30)]
    out += ["Licensed under the Apache License, Version 2.0", "x CC BY-NC 4.0 y MIT License", "same line\nsame line\n\nother"]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    made = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return made + [made[9], (None, "no id at all", "en", "s1", 12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # an extra column whose name clashes with what operators use inside
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", rk long, did string").repartition(3)


def _by_id(df):
    return sorted(map(tuple, df.collect()), key=str)


def _order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def _removed(rows, split, width):
    first = {}
    key = lambda r: 2**63 if r[0] is None else r[0]
    for r in rows:
        t = split(r[1] or "")
        for i in range(len(t) - width + 1):
            w = tuple(t[i : i + width]) if isinstance(t, list) else t[i : i + width]
            first[w] = min(first.get(w, key(r)), key(r))
    for r in _order(rows):
        t = split(r[1] or "")
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            w = tuple(t[i : i + width]) if isinstance(t, list) else t[i : i + width]
            if first[w] < key(r):
                gone[i : i + width] = [True] * width
        yield r, t, gone


def test_substring(docs, rows):
    want = []
    for r, t, gone in _removed(rows, WORD.findall, 13):
        kept = " ".join(w for w, g in zip(t, gone, strict=True) if not g)
        want.append((r[0], len(t), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring.passage_removal(docs, texts=False)
    assert _by_id(got) == sorted(want, key=str) and any(w[2] for w in want)


def test_suffix_array_dedup(docs, rows):
    want = []
    for r, t, gone in _removed(rows, lambda x: x.encode(), 50):
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_array.substring_removal(docs)
    assert _by_id(got.drop("kept")) == sorted(want, key=str) and any(w[2] for w in want)


@pytest.mark.parametrize("operator", [substring, suffix_array])
def test_hot_anchors_batches_and_shards(spark, monkeypatch, docs, operator):
    """Anchors that are taken apart, small batches, small pieces of texts and small shards give what others give."""
    found = lambda: {(r.did, r.rk): sorted({s for x in r.spans for s in range(x >> 32, (x & 0xFFFFFFFF) + 1)}) for r in operator.removals(docs).collect()}
    want = found()
    monkeypatch.setattr(operator, "PLAN", dataclasses.replace(operator.PLAN, hot=2))
    assert want and found() == want
    monkeypatch.setattr(anchors, "small_batches", lambda spark: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    assert found() == want
    monkeypatch.setattr(operator, "PLAN", dataclasses.replace(operator.PLAN, hot=6))
    monkeypatch.setattr(operator, "SHARD", 300)
    assert found() == want


def test_pieces_of_long_texts(monkeypatch):
    text = bytes(random.Random(4).choice(b"abc") for _ in range(3000))
    whole = [np.concatenate(x) for x in zip(*anchors.scan([text], suffix_array.PLAN), strict=True)]
    monkeypatch.setattr(anchors, "PIECE", 700)
    monkeypatch.setattr(anchors, "CHUNK", 1000)
    cut = [np.concatenate(x) for x in zip(*anchors.scan([text], suffix_array.PLAN), strict=True)]
    spoken = lambda x: {(int(s), int(h)) for h, lo, hi in zip(x[1], x[2], x[3], strict=True) for s in range(lo, hi + 1)}
    assert spoken(whole) == spoken(cut) and len(spoken(whole)) == 3000 - 49


def test_compact():
    at = lambda *x: np.array(x, np.int64).tobytes()
    table = pa.table({"did": [1, 1, 4, 2, 3], "rk": [7, 8, 9, 7, 7], "at": [at(3), at(3), at(3, 5), at(3), at(3)], "snippet": [b"a", b"a", b"a", b"b", b"b"], "done": [False] * 5})
    said, rest = anchors._compact(table)
    assert said[0].to_pydict() == {"did": [4, 4, 3], "rk": [9, 9, 7], "span": [3, 5, 3]}
    assert pa.Table.from_batches(rest).column("did").to_pylist() == [1, 1, 2]


@pytest.mark.parametrize("symbols", [2, 3, 5, 200])
def test_suffix_arrays(symbols):
    rng = np.random.default_rng(symbols)
    for _ in range(60):
        t = np.concatenate((rng.integers(1, symbols, rng.integers(1, 80)), [0]))
        assert suffix_array.suffix_array(t, symbols).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_arrays_recurse(monkeypatch):
    """On text every depth is sorted by induction; runs and copies included."""
    depths, plain = [], suffix_array.suffix_array
    monkeypatch.setattr(suffix_array, "suffix_array", lambda t, n: (depths.append((len(t), n)), plain(t, n))[1])
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = "".join(rng.choice(words) for _ in range(6000)) + "a" * 5000 + "".join(words) * 3
    t = np.concatenate((np.frombuffer(text.encode(), np.uint8).astype(np.int64), [0]))
    sa = suffix_array.suffix_array(t, 256)
    assert len(depths) > 3 and all(x[0] > 2 * y[0] for x, y in zip(depths, depths[1:], strict=False))
    rank = np.empty(len(t), np.int64)
    rank[sa] = np.arange(len(t))
    a, b = sa[:-1], sa[1:]  # in order: by the first symbol, then by the rest's rank
    assert (np.sort(sa) == np.arange(len(t))).all()
    assert ((t[a] < t[b]) | ((t[a] == t[b]) & (rank[np.minimum(a + 1, len(t) - 1)] < rank[np.minimum(b + 1, len(t) - 1)]))).all()


def _snippets(rng):
    made = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(4, 30))) for _ in range(rng.randint(1, 12))]
    return made + [rng.choice(made)[:20] + rng.choice(made) for _ in range(5)]


def test_common_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        snippets = _snippets(rng)
        symbols = [x for s in snippets for x in [*(c + 2 for c in s), 1]] + [0]
        rest = np.array([len(s) - i for s in snippets for i in range(len(s) + 1)])
        data = np.frombuffer(b"\x00".join(snippets) + b"\x00", np.uint8)
        sa = suffix_array.suffix_array(np.array(symbols), 258)[1:]
        got = suffix_array.common_prefixes(data, sa, rest)
        assert got[sa[0]] == 0
        for a, b in zip(sa.tolist(), sa[1:].tolist(), strict=False):
            n = next(k for k in range(len(symbols)) if symbols[a + k] != symbols[b + k])
            assert got[b] == min(n, rest[a], rest[b])


@pytest.mark.parametrize("operator", [substring, suffix_array])
def test_repeated_windows_of_a_shard(operator):
    rng = random.Random(2)
    for _ in range(60):
        snippets = _snippets(rng)
        if operator is substring:
            snippets = [b" ".join(bytes([97 + c % 3]) for c in s) for s in snippets]
        snippets = sorted(set(snippets))
        documents = [rng.randrange(5) for _ in snippets]
        split = (lambda s: s.split()) if operator is substring else bytes
        windows = [[tuple(split(s)[i : i + 4]) for i in range(len(split(s)) - 3)] for s in snippets]
        first = {}
        for w, d in zip(windows, documents, strict=True):
            for x in w:
                first[x] = min(d, first.get(x, d))
        got = operator.repeated(snippets, documents, 4)
        assert [x.tolist() for x in got] == [[i for i, x in enumerate(w) if first[x] < d] for w, d in zip(windows, documents, strict=True)]


def test_automaton():
    rng = random.Random(2)
    for _ in range(40):
        known = [[rng.randrange(3) for _ in range(rng.randrange(1, 15))] for _ in range(4)]
        tool = automaton.SuffixAutomaton()
        for k in known:
            tool.add(k)
        text = [rng.randrange(3) for _ in range(30)]
        runs = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        want = [max((n for n in range(1, e + 2) if tuple(text[e + 1 - n : e + 1]) in runs), default=0) for e in range(30)]
        assert list(tool.matching(text)) == want


def _fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(docs, rows):
    prints = [_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    want = sorted(((r[0], prints[i], least[find(i)]) for i, r in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_copies(docs).collect()), key=str)
    assert got == want


def test_balls_connect_all_within_the_radius(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for s in seeds for _ in range(25)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    assert all(((r.u ^ r.v) % 2**64).bit_count() <= 3 for r in links.collect())
    rooted = {r.u: r.root for r in components.components(links).collect()}
    group = {p: rooted.get(p, p) for p in signed}
    for a in signed:
        for b in signed:
            if ((a ^ b) % 2**64).bit_count() <= 3:
                assert group[a] == group[b]


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


def test_encoder_is_the_tokenizer(encoder):
    rng = random.Random(3)
    letters = "aZéÉΣσςİıßẞ'’,.—…-_<|>0１²ªǅ́  \xa0\x1c日\t\n😀" + "'s don't"
    for i in range(4000):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) + "<|endoftext|>" * (i % 50 == 0)
        assert encoder.tool.encode(x, add_special_tokens=False).ids == np.frombuffer(encoder.ids(x.encode()), "<u2").tolist()


def test_many_texts_are_encoded_at_once(encoder):
    """Ids are the tokenizer's; each different word is looked up once for many texts; words of letters need no call each."""
    rng = random.Random(6)
    letters = "aaZzeéÉñßſİıĲŉǅȺΣ'’,.$<|0１²́ \x1c\x85日\n\t\v"
    texts = ["", " \n", "a", "b" * 47, "b" * 48, "b" * 49, "é" * 24, "é" * 25, "é" * 24 + ",", "x" * 5000, "Ab<|endoftext|>Cd eF", "Eé, eÉ. EÉ"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [" ".join("".join(rng.choice("theinoatré") for _ in range(rng.randint(1, 40))) + rng.choice(["", ",", "$$$"]) for _ in range(20)) for _ in range(150)]
    want = [encoder.tool.encode(x, add_special_tokens=False).ids for x in texts]
    for together, bound, merges in ((1 << 20, 600_000, True), (300, 600_000, True), (300, 50, True), (1 << 20, 600_000, False)):
        enc = Encoder()
        enc.together, enc.bound = together, bound
        enc.merges = enc.merges if merges else None
        for _ in range(2):
            assert [np.frombuffer(x, "<u2").tolist() for x in enc.all_ids([x.encode() for x in texts])] == want
    assert list(encoder.all_ids([])) == []

    class Counted(Encoder):
        asked = 0

        def get(self, *word):
            self.asked += 1
            return super().get(*word)

    enc = Counted()
    enc.model = None
    got = list(enc.all_ids([b"some words Some,\n" * 500, b"words some"] * 20))
    assert enc.asked <= 4 and got[1] == encoder.ids(b"words some") and got[0] == encoder.ids(b"some words Some,\n") * 500


def test_token_store(spark, docs, rows, encoder, tmp_path):
    store.write_store(docs, f"file://{tmp_path}/store")
    got = store.read_store(spark, f"file://{tmp_path}/store").collect()
    at, left = 0, Counter((r[0], len(i := encoder.tool.encode(r[1] or "", add_special_tokens=False).ids + [2]), zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        left[(r.doc_id, r.n_tokens, r.ids_crc32)] -= 1
    assert not +left and len(got) == len(rows)
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[:-1] == sorted(ids[:-1]) and ids[-1] is None


def test_a_damaged_store_is_an_error(spark, docs, tmp_path):
    path = tmp_path / "store"
    store.write_store(docs, f"file://{path}", part=2000)
    read = lambda: store.read_store(spark, f"file://{path}").count()
    whole, files = read(), sorted((path / "documents").glob("*.parquet"))
    assert whole == docs.count() and len(files) > 3
    rows = spark.read.parquet(f"file://{path}/documents").collect()
    assert all(sum(r.n_tokens for r in rows if r.part == p) < 2000 + max(r.n_tokens for r in rows) for p in {r.part for r in rows})

    def with_table(name, table):
        kept = path / f"kept-{name}"
        (path / name).rename(kept)
        spark.createDataFrame(table, spark.read.parquet(f"file://{kept}").schema).write.parquet(f"file://{path}/{name}")
        try:
            with pytest.raises(Exception, match="manifest|digest|root|chunks|starts"):
                read()
        finally:
            import shutil

            shutil.rmtree(path / name)
            kept.rename(path / name)

    kept = files[1].rename(tmp_path / files[1].name)  # a lost file
    with pytest.raises(ValueError, match="fail the manifest"):
        read()
    kept.rename(files[1])
    assert read() == whole
    with_table("documents", rows[1:])  # a lost row
    with_table("documents", [*rows, rows[3]])  # a row twice
    changed = next(r for r in rows if len(r.payload) > 4)
    with_table("documents", [r if r is not changed else type(r)(**(r.asDict() | {"payload": bytearray(b"??") + r.payload[2:]})) for r in rows])  # an altered chunk
    with_table("documents", [type(r)(**(r.asDict() | {"n_tokens": r.n_tokens + 1})) for r in rows])
    said = spark.read.parquet(f"file://{path}/manifest").collect()
    with_table("manifest", said[1:])  # a lost part that the manifest doesn't name either


def test_merkle_one_by_one():
    for n in range(40):
        leaves, tree = [bytes([i]) for i in range(n)], store.Merkle()
        for x in leaves:
            tree.add(x)
        assert tree.root() == store.merkle(leaves)


def test_parts_inside_one_doc_id(spark, encoder, tmp_path):
    """Rows without an id share one place in the order, and are dealt to several parts all the same."""
    docs = spark.createDataFrame([(None if i % 2 else i, f"word {i} " * (i % 9)) for i in range(200)] + [(4, "long " * 4000)], "doc_id long, text string").repartition(5)
    store.write_store(docs, f"file://{tmp_path}/store", part=300)
    got = sorted(store.read_store(spark, f"file://{tmp_path}/store").collect(), key=lambda r: r.start)
    assert len(got) == 201 and [r.start + r.n_tokens for r in got[:-1]] == [r.start for r in got[1:]]
    ids = [r.doc_id for r in got]
    assert ids == sorted((i for i in ids if i is not None)) + [None] * 100
    store.write_store(docs.limit(0), f"file://{tmp_path}/none")
    assert store.read_store(spark, f"file://{tmp_path}/none").count() == 0


def test_crc_join_and_chunks():
    parts = [random.Random(n).randbytes(n) for n in (4, 100, 0, 7, 1024)]
    assert store.crc_join([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))
    ids = np.random.default_rng(1).integers(0, 40_000, 30_000).astype("<u2")
    one, two = store.chunk_ends([ids.tobytes(), np.concatenate((ids[:777], ids)).astype("<u2").tobytes()])
    assert len({e + 777 for e in one} & set(two)) > 0.9 * len(one) and one[-1] == 30_000


def test_repeated_words_make_no_chunk_each():
    """Streams of two ids over and over: where the rolling hash cuts at all, it would cut every other id."""
    for a in range(400):
        ids = np.array([a, a + 1] * 1000 + [2], "<u2").tobytes()
        before, ends = store.chunk_ends([b"\1\0" * 5, ids])
        assert before == [5] and ends[-1] == 2001 and len(ends) <= 2001 // 32 + 1


def test_copies_ask_for_their_chunks_once(spark, encoder, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    long = " ".join(word() for _ in range(1500))
    texts = [long] * 40 + [f"{word()} {long}" for _ in range(3)] + [f"{word()} " * 900] * 2
    store.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), f"file://{tmp_path}/store")
    rows = spark.read.parquet(f"file://{tmp_path}/store/documents")
    chunks = max(len(r.recipe) // 16 for r in rows.collect())
    assert 10 < chunks and chunks <= store._asked(store._verified(rows)).count() < 6 * chunks
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in store.read_store(spark, f"file://{tmp_path}/store").collect()}
    ids = [[*encoder.tool.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}


def test_packing(docs, rows, encoder):
    got = packing.pack(docs).collect()
    assert sum(r.start == 0 for r in got) == len(rows)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in windows.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is not None:
            ids = np.array(encoder.tool.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
            assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_best_fit_is_piece_by_piece():
    rng = random.Random(9)
    for _ in range(50):
        counts = Counter(rng.randint(1, 64) for _ in range(rng.randint(1, 300)))
        free, opened = [], 0
        for length in sorted(counts.elements(), reverse=True):
            fit = min((r for r in free if r >= length), default=None)
            if fit is None:
                opened += 1
                fit = 64
            else:
                free.remove(fit)
            free.append(fit - length)
        used = Counter()
        for length, _, pieces, first, per, offset in packing.best_fit_decreasing(counts, 64):
            for x in range(pieces):
                used[first + x // per] += length
                assert offset + length * (x % per + 1) <= 64
        assert len(used) == opened and max(used.values()) <= 64 and sum(used.values()) == sum(counts.elements())


def test_sharding(docs, rows):
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    of = {}
    for r in got:
        assert of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    sizes = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5])
    best = min(max(map(sum, np.split(sizes, [i, j]))) for i in range(12) for j in range(i, 12))
    assert sharding.smallest_capacity(sizes, 3) == best == max(map(sum, np.split(sizes, sharding.cuts(sizes, 3))))


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_sharding_is_minimax(spark, rows, docs, monkeypatch, bits):
    """The largest shard is the least that any contiguous cut of whole texts in order of their hash gives."""
    monkeypatch.setattr(sharding, "RANGE_BITS", bits)
    monkeypatch.setattr(sharding, "SPLIT", 4)
    hashed = docs.selectExpr("xxhash64(coalesce(text, '')) as key", "octet_length(coalesce(text, '')) + 1 as size").groupBy("key").agg(F.sum("size").alias("size")).collect()
    sizes = [r["size"] for r in sorted(hashed, key=lambda r: r.key)]
    for shards in (2, 5, 16):
        best = [0, *([10**9] * len(sizes))]  # least largest run, of the first n groups
        for _ in range(shards):
            best = [min(max(best[i], sum(sizes[i:n])) for i in range(n + 1)) for n in range(len(sizes) + 1)]
        got = sharding.shard(docs, shards).collect()
        assert max(sum(r["size"] for r in got if r.shard == k) for k in range(shards)) == best[-1]
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), "bytes", None) for r in rows)


def test_host_verdicts(spark):
    """Against a plain version, with hosts that are rejected, one by very few documents, and a null host."""
    rng = random.Random(3)
    good, bad = "word%d " * 60, "few words"
    made = [(h, good % tuple(rng.randrange(99) for _ in range(60)) if rng.random() > p else bad) for h, n, p in [("a", 90, 0.9), ("b", 200, 0.1), ("c", 1, 1.0), (None, 40, 0.8), ("d", 60, 0.3), ("e", 60, 0.45)] for _ in range(n)]
    docs = spark.createDataFrame([(i, t, h, "x") for i, (h, t) in enumerate(made)], "doc_id long, text string, source string, host string")
    failed, n = Counter(h for h, t in made if t == bad), Counter(h for h, _ in made)
    rates = [failed[h] / n[h] for h in n]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    strength = max(1, m * (1 - m) / v - 1)
    shrunk = {h: (failed[h] + m * strength) / (n[h] + strength) for h in n}
    got = {r.doc_id: r for r in hosts.host_rules(docs).collect()}
    for i, (h, t) in enumerate(made):
        assert got[i].host_rate == round(shrunk[h], 6) and got[i].kept == (t != bad and shrunk[h] <= 0.5) and got[i].base_failed == (t == bad)
    assert any(not g.kept and not g.base_failed for g in got.values()) and any(g.kept for g in got.values())


def test_base_counts(rows):
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice), len(lines))
        assert hosts.base_counts(t.encode()) == want


def test_host_rules(docs, rows):
    got = hosts.host_rules(docs).collect()
    assert len(got) == len(rows) and all(not (r.kept and r.base_failed) and r.kept is not None for r in got)


def test_licences(docs, rows):
    got = {r.doc_id: r for r in licences.licence_scan(docs).collect()}
    for r in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        at = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        g = got[r[0]]
        assert (g.n_words, g.n_base, g.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (g.first_word, g.last_word) == (min(at)[0] if at else None, max(at)[0] if at else None) and 0 <= g.score <= 1
    assert any("cc-by-nc" in g.labels for g in got.values())


def test_licence_labels_and_score(spark):
    """Labels and score against a plain chain over the longest runs of words that end at each place and go no further."""
    rng = random.Random(7)
    texts = [None, "", "x" * 9]
    for name, t in licences.TEMPLATES.items():
        w = t.split()
        for cut_ in range(6):
            part = [x for x in w if rng.random() > cut_ / 12]
            texts.append(" ".join(["Some"] * rng.randint(0, 3) + part[: rng.randint(3, len(part))] + ["other", "words"]))
            at = rng.randrange(len(w))
            texts.append(" ".join(w[:at] + [f"n{k}" for k in range(rng.randint(0, 10))] + w[at:]))
    texts += ["MIT License", "cc by, cc-by and CC BY 4.0", " ".join(licences.TEMPLATES.values())]
    got = licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    known = set()
    for r in sorted(got, key=lambda r: r.doc_id):
        w = licences.licence_words((texts[r.doc_id] or "").encode())
        base = {label for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()}
        labels, score = set(base), float(bool(base))
        known = known or {run for x in [*licences.TEMPLATES.values(), *licences.PHRASES] for p in [x.encode().split()] for i in range(len(p)) for j in range(i + 1, len(p) + 1) for run in [tuple(p[i:j])]}
        longest = [next((n for n in range(min(e, 60), 0, -1) if tuple(w[e - n : e]) in known), 0) for e in range(len(w) + 1)] + [0]
        stop = [(e, n) for e, n in enumerate(longest[:-1]) if n >= licences.MIN_MATCH and longest[e + 1] != n + 1]
        for label, t in licences.TEMPLATES.items():
            p = t.encode().split()
            runs = [(e - n, y, n) for e, n in stop for y in range(len(p) - n + 1) if p[y : y + n] == w[e - n : e]]
            cover = licences._chain(runs) / len(p) if runs else 0.0
            score = max(score, cover)
            if cover >= licences.MIN_COVER:
                labels.add(label)
        assert (r.labels, round(r.score, 9)) == (",".join(sorted(labels)), round(score, 9)), texts[r.doc_id]


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 50)))) for i in range(25)]
    clean = [" ".join(word() for _ in range(200)) for _ in range(30)]
    leaked = [f"{clean[i]} {items[i][1].upper()}, {clean[i + 1]}" for i in range(20)]
    swapped = [" ".join([*items[i][1].split()[:-1], "changed"]) for i in range(25)]
    texts = [None, "", *clean, *leaked, *swapped]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, spark.createDataFrame([*items, (99, None)], "item_id long, text string")).collect()}

    def best(text, item):
        w, t = licences.licence_words(text.encode()), licences.licence_words(item.encode())
        n = min(len(t), len(w))
        want = Counter(zip(*(t[k:] for k in range(5)), strict=False))
        sims = [0.0]
        for s in range(len(w) - n + 1):
            have = Counter(zip(*(w[s + k : s + n] for k in range(5)), strict=False))
            sims.append((have & want).total() / (have | want).total())
        return max(sims)

    want = {(i, k): best(t, x) for i, t in enumerate(texts) if t for k, x in items}
    assert got == {k: v for k, v in want.items() if v >= 0.8}
    kept = decontaminate.without_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in got}


def test_decontamination_of_short_items(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in [1, 2, 3, 4, 5, 6, 9, 40, 40, 40, 200] * 4]
    texts += ["long " * 30 + "Three little, words" + " tail" * 30, "three little", "three other little words", None, ""]
    items = [(k, " ".join(rng.choice("abcdef") for _ in range(n))) for k, n in enumerate([1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 5, 6, 12])] + [(13, "three little words"), (14, "absent"), (15, "?!")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, text in enumerate(texts):
        w = licences.licence_words((text or "").encode())
        for k, item in items:
            t = licences.licence_words(item.encode())
            size, n = min(5, len(t)), min(len(t), len(w))
            grams = lambda x: Counter(tuple(x[j : j + size]) for j in range(len(x) - size + 1))
            sims = [((have := grams(w[s : s + n])) & grams(t)).total() / max(1, (have | grams(t)).total()) for s in range(len(w) - n + 1)] if t and w else []
            if sims and max(sims) >= 0.8:
                want[i, k] = (sims.index(max(sims)), n, max(sims))
    got = {(r.doc_id, r.item_id): (r.first_word, r.window_words, r.similarity) for r in decontaminate.leaks(docs, marks).collect()}
    assert got == want and (44, 13) in got and {k for _, k in got} >= set(range(6))
    assert {r.doc_id for r in decontaminate.without_leaks(docs, marks).collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_decontamination_ties_repeats_and_long_texts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    hot = "one two three four five six"
    items = [(i, " ".join([word() for _ in range(rng.randint(1, 30))] + [hot])) for i in range(300)]
    items += [(500, items[7][1]), (None, items[8][1])]
    long_ = " ".join(word() for _ in range(30_000))
    docs = [(1, f"{items[7][1]} x {items[7][1]}"), (1, f"{items[7][1]} x {items[7][1]}"), (None, items[8][1]), (3, f"{long_} {items[9][1]} {long_}"), (4, f"{hot} " * 700), (5, hot)]
    got = [tuple(r) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).drop("did", "rk").collect()]
    size = lambda i: len(items[i][1].split())
    want = [(1, 7, 0, size(7), 1.0), (1, 500, 0, size(7), 1.0)] * 2 + [(None, 8, 0, size(8), 1.0), (None, None, 0, size(8), 1.0), (3, 9, 30_000, size(9), 1.0)]
    assert sorted(map(str, (r for r in got if r[0] not in (4, 5)))) == sorted(map(str, want))
    index = decontaminate.Index([(i, t.encode()) for i, t in items])
    assert max(map(len, index.where.values())) <= 20  # the hot shingles stand for few items


def test_quality(spark, tmp_path):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocab) for _ in range(40)]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            words[3] = rng.choice(["vilest", "viler"])
        text = " ".join(w.upper() + "!!#" for w in words) if bad else " ".join(words)
        rows.append((i, None if i == 899 else text, rng.choice(["en", None]), f"s{i % 4}", len(text)))
        if i % 2 or i % 3 == 0:
            labels.append((i, int(not bad), int(toxic)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.classify(docs, marks).collect()}
    held = [i for i in range(898) if i not in {x[0] for x in labels}]
    right = sum(got[i] == (i % 5 != 0 and i % 7 != 0) for i in held)
    assert len(got) == 900 and right > 0.95 * len(held)
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in quality.stage(spark, docs, str(tmp_path)).collect()} == {i for i, kept in got.items() if kept}
    assert quality.classify(docs.limit(0), marks).count() == 0
    assert all(r.kept for r in quality.classify(docs.limit(5), marks.limit(0)).collect())


def test_views_are_apart_and_fits_are_plain():
    """The metadata view never sees the text; weights and calibration are what plain gradient descent and Newton give."""
    assert quality.meta_view("en", "s", 5).tolist() == quality.meta_view("en", "s", 5).tolist() != quality.meta_view("en", "t", 5).tolist()
    assert quality.text_view(b"A b\nA b").max() < (1 << quality.BITS) + quality.LAYOUT
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(300)]
    y = np.array([float((3 in r) or rng.random() < 0.2) for r in rows])
    x = quality.Sparse.of(rows)
    dense = np.zeros((300, 12))
    for i, r in enumerate(rows):
        dense[i, r] = 1
    up, down = dense[y > 0].sum(0), dense[y == 0].sum(0)
    pos, neg, share = y.sum(), 300 - y.sum(), y.mean()
    scale = np.log((up + 1) / (pos + 2)) - np.log((down + 1) / (neg + 2))
    odd = np.abs(up - (up + down) * share) / np.sqrt((up + down) * share * (1 - share) + 1e-9)
    scale[(np.abs(scale) < quality.LEAST_ODDS) | (odd < quality.LEAST_SURPRISE)] = 0
    used = np.flatnonzero(scale)
    a, weight = dense[:, used] * scale[used], np.where(y > 0, 0.5 / pos, 0.5 / neg)
    w, b, vw, vb = np.full(len(used), 0.1), 0.0, 0.0, 0.0
    rate = 4 / max(1.0, (a**2).sum(1).mean())
    for _ in range(150):
        r = (1 / (1 + np.exp(-(a @ w + b))) - y) * weight
        vw, vb = 0.9 * vw - rate * (a.T @ r + 1e-3 * w), 0.9 * vb - 0.5 * r.sum()
        w, b = w + vw, b + vb
    want = np.zeros(12)
    want[used] = w * scale[used]
    got, bias = quality.fit_view(x, y, 12)
    assert len(used) and np.allclose(got, want) and np.isclose(bias, b) and np.allclose(x.dot(got), dense @ want)
    assert np.allclose(x.part(4, 9).dot(got[4:9]), dense[:, 4:9] @ want[4:9])
    z = np.column_stack((dense @ want, rng.normal(size=300)))
    *mix, c = quality.calibrate(z, y)
    s = (z - z.mean(0)) / (z.std(0) + 1e-6)
    cost = lambda m, k: np.mean(np.log1p(np.exp(-(2 * y - 1) * (z @ m + k)))) + 5e-4 * ((np.array(m) * (z.std(0) + 1e-6)) ** 2).sum() + 5e-4 * (k + z.mean(0) @ np.array(m)) ** 2
    assert s.shape == z.shape and all(cost(np.array(mix) + d, c) >= cost(np.array(mix), c) for d in 0.01 * np.array([[1, 0], [-1, 0], [0, 1], [0, -1]]))


def test_pseudo_labels_come_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "GIVEN", 40)
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows = []
    for i in range(4000):
        words = [rng.choice(vocab) for _ in range(20)] + (["vile"] if i % 3 == 0 else ["kind"]) * rng.randint(0, 3)
        rows.append((None if i == 3999 else i, " ".join(words) if i % 50 else "kind copy", "en", "bad" if i % 3 == 0 else "good", 1))
    feats = quality._featured(spark.createDataFrame(rows, SCHEMA).repartition(7)).cache()
    plain = [(r.did, r.key, r.rk, quality.text_view(rows[3999 if r.did is None else r.did][1].encode()), quality.meta_view("en", rows[3999 if r.did is None else r.did][3], 1)) for r in feats.select("did", "key", "rk").collect()]
    assert {(r.key, tuple(quality._unpacked(r.t)), tuple(quality._unpacked(r.m))) for r in feats.collect()} == {(k, tuple(t), tuple(m)) for _, k, _, t, m in plain}
    first = sorted((x for x in plain if x[0] is not None and x[0] < 600), key=lambda x: x[0])
    head = quality.Head([[x[3] for x in first], [x[4] for x in first]], np.array([float(x[0] % 3 > 0) for x in first]))
    head.fit()
    head.given[1][plain[1000][2]] = (plain[1000][4], 1.0)
    got = quality.choose(feats, {"quality": head}, np.arange(600))
    for v, (w, b, mix) in enumerate(head.judges()):
        for kind in (0, 1):
            want, texts = [], set(head.given[1 - v])
            for neg, key, rk in sorted((-round(float(p if kind else 1 - p), 9), x[1], x[2]) for x in plain if x[0] is None or x[0] >= 600 for p in [quality._sigmoid(mix[0] * (w[x[3 + v]].sum() + b) + mix[1])] if (p if kind else 1 - p) >= quality.SURE):
                if rk not in texts:
                    texts.add(rk)
                    want.append((neg, key))
            assert [int(r["key"]) for r in got["quality", v, kind]] == [k for _, k in want[: head.most(kind)]]
            assert len(got["quality", v, kind]) == head.most(kind)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for f in (lambda d: substring.passage_removal(d), suffix_array.substring_removal, simhash.near_copies, packing.pack, sharding.shard, hosts.host_rules, licences.licence_scan, lambda d: decontaminate.leaks(d, d.selectExpr("doc_id item_id", "text"))):
        assert f(none).count() == 0


def test_stages(spark, docs, rows, tmp_path):
    """Every stage takes all its predecessor kept, and all but the last return the columns of documents."""
    clash = {"fp": F.lit(1.5), "kept": F.col("did"), "__row": F.lit(7), "r": F.to_timestamp(F.lit("2020-01-01 00:00:00.123456")), "n_bytes": F.array(F.lit("q")), "a.b": F.lit(None).cast("string")}
    own = docs.withColumns(clash)
    spark.createDataFrame([(1, _texts()[10])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    least = {(min(x[0] for x in rows if x[0] is not None and x[1] == r[1]) if r[0] is not None else None) for r in rows}
    now = own
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = f"{tmp_path}/stage{k}"
        stage(spark, now, str(tmp_path)).write.parquet(out)
        now = spark.read.parquet(out)
        assert now.columns == own.columns and now.count() > 0
        assert now.select("rk", "did", *[f"`{c}`" for c in clash]).distinct().collect() == own.select("rk", "did", *[f"`{c}`" for c in clash]).distinct().collect()
        if k == 1:
            assert {r.doc_id for r in now.collect()} <= least and now.count() == now.distinct().count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_registered():
    assert {q.split("_")[0] for q in registry.queries()} == {f"op{n}" for n in range(1, 11)}
