"""Operator 1: quality by co-training of a text view and a page-metadata view.

Two questions are learnt, each by two logistic classifiers that see different views of a document: is it good, and is
it toxic. The text view is all that the text itself says: the presence of words and word beginnings and its layout (size,
lines, signs, digits, capitals), hashed, each scaled by its smoothed log-odds. The metadata view never sees the text: it
is source, language and the length column, alone and in pairs. In each round either classifier scores all documents and
labels the GIVEN it is surest of for the other; equal texts count once. Both are then calibrated on held-out labelled
rows and their calibrated logits combined. Training uses at most LABELLED labelled rows, those with the least hash of
doc_id. Features are written once for the rounds; the last scoring is one pass without a shuffle.

Edge cases: null text has no words; null metadata is a value of its own; without labels of both kinds everything is
kept with score 0.5; null doc_id is scored like any other; repeated rows are scored each; a very long text is one set of
features; an empty table gives no rows; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from driftforge.llm.common import NO_ID, arrow_rows, blobs, cut, drop, filtered, ints, small_batches, table
from driftforge.llm.licences import licence_words

LABELLED = 8192
ROUNDS = 3
#: Documents that a classifier hands over in a round, of both kinds together, and the surety it needs.
GIVEN, SURE = 409, 0.95
BITS = 20
#: Of a feature that counts: log-odds, and standard deviations from what chance gives.
LEAST_ODDS, LEAST_SURPRISE = 0.7, 4.5
#: Feature numbers of the text's layout, which follow those of words, and of metadata.
LAYOUT, META = 512, 1 << 16
REJECT = 0.5


class _Features(dict):
    """Word -> three feature numbers in one integer: the word, its first four and its first six bytes."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        v = 0
        for k, part in enumerate((w, b"4" + w[:4], b"6" + w[:6])):
            v |= (xxh32_intdigest(part, k) & ((1 << BITS) - 1)) << (BITS * k)
        self[w] = v
        return v


_words = _Features()


def _level(v: float) -> int:
    return int(min(31, max(0, np.log2(v * 1000 + 1))))


def layout(x: bytes) -> tuple[str, ...]:
    n = max(1, len(x))
    lines = x.split(b"\n")
    signs = n - len(x.translate(None, b"#*$%&|<>!_=+~^"))
    digits = n - len(x.translate(None, b"0123456789"))
    upper = n - len(x.translate(None, bytes(range(65, 91))))
    return (
        f"size {int(np.log2(n))}", f"lines {int(np.log2(len(lines)))}", f"line {_level(n / len(lines) / 1000)}", f"signs {_level(signs / n)}", f"digits {_level(digits / n)}",
        f"upper {_level(upper / n)}", f"word {min(31, n // max(1, len(x.split())))}", f"same {_level(len(set(lines)) / len(lines))}",
    )


def text_view(x: bytes) -> np.ndarray:
    words = set(licence_words(x))
    packed = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    facts = np.array([(1 << BITS) + xxh32_intdigest(f.encode()) % LAYOUT for f in layout(x)], np.int64)
    return np.unique(np.concatenate([facts, *((packed >> (BITS * k)) & ((1 << BITS) - 1) for k in range(3))]))


@lru_cache(100_000)
def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    size = None if n_chars is None else int(np.log2(max(0, n_chars) + 1))
    facts = (f"lang {lang}", f"source {source}", f"size {size}", f"lang source {lang} {source}", f"lang size {lang} {size}", f"source size {source} {size}")
    return np.unique(np.array([xxh32_intdigest(f.encode()) & (META - 1) for f in facts], np.int64))


@dataclass
class Sparse:
    """Rows of feature numbers."""

    at: np.ndarray
    col: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sparse:
        return cls(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64), np.concatenate([*rows, np.empty(0, np.int32)]))

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1, dtype=np.int32), np.diff(self.at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(self.at) - 1), self.rows()
        for part in _parts(len(rows)):
            out += np.bincount(rows[part], w[self.col[part]], len(out))
        return out

    def part(self, lo: int, hi: int) -> Sparse:
        """The features from lo to hi, numbered from 0."""
        mine = (self.col >= lo) & (self.col < hi)
        return Sparse(np.concatenate(([0], np.cumsum(mine)))[self.at], self.col[mine] - lo)


def _parts(n: int, most: int = 1 << 20) -> list[slice]:
    """numpy widens what it counts to 64 bits: long arrays are counted part by part."""
    return [slice(at, at + most) for at in range(0, n, most)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_view(x: Sparse, y: np.ndarray, size: int, steps: int = 150, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic weights over presence scaled by smoothed log-odds; gradient descent with momentum, classes balanced."""
    rows = x.rows()
    pos, neg = y.sum(), len(y) - y.sum()
    on = (y > 0)[rows]
    up, down = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for part in _parts(len(rows)):
        up += np.bincount(x.col[part][on[part]], minlength=size)
        down += np.bincount(x.col[part][~on[part]], minlength=size)
    scale = np.log((up + 1) / (pos + 2)) - np.log((down + 1) / (neg + 2))
    share = pos / max(1, len(y))
    surprise = (up - (up + down) * share) / np.sqrt((up + down) * share * (1 - share) + 1e-9)
    scale[(np.abs(scale) < LEAST_ODDS) | (np.abs(surprise) < LEAST_SURPRISE)] = 0.0
    used = (scale != 0)[x.col]
    kept, col = np.unique(x.col[used], return_inverse=True)
    rows, value = rows[used], scale[x.col[used]]
    weight = np.where(y > 0, 0.5 / max(1, pos), 0.5 / max(1, neg))
    w, b = np.full(len(kept), 0.1), 0.0
    vw, vb = np.zeros(len(kept)), 0.0
    rate = 4.0 / max(1.0, np.mean(np.bincount(rows, value**2, len(y))))
    for _ in range(steps):
        r = (_sigmoid(np.bincount(rows, w[col] * value, len(y)) + b) - y) * weight
        gw, gb = np.bincount(col, r[rows] * value, len(kept)) + decay * w, r.sum()
        vw, vb = 0.9 * vw - rate * gw, 0.9 * vb - 0.5 * gb
        w, b = w + vw, b + vb
    out = np.zeros(size)
    out[kept] = w * scale[kept]
    return out, b


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression of y on the columns of z, standardised; returns weights and intercept."""
    m, s = z.mean(0), z.std(0) + 1e-6
    x = np.column_stack(((z - m) / s, np.ones(len(z))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p))[:, None] / len(y)) + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) / len(y) + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate((w[:-1] / s, [w[-1] - (w[:-1] * m / s).sum()]))


@dataclass
class Model:
    text: np.ndarray
    text_bias: float
    meta: np.ndarray
    meta_bias: float
    mix: np.ndarray

    def score(self, t: np.ndarray, m: np.ndarray) -> float:
        z = self.mix[0] * (self.text[t].sum() + self.text_bias) + self.mix[1] * (self.meta[m].sum() + self.meta_bias) + self.mix[2]
        return float(_sigmoid(z))


class Head:
    """A question's two views: text and metadata features of labelled rows, their labels, and what each view was given.

    Of the labelled rows a tenth weighs the text view's two halves, words and layout, against each other, and another
    tenth calibrates the views and their sum; the others train.
    """

    def __init__(self, views: list[list[np.ndarray]], y: np.ndarray) -> None:
        self.views, self.y = views, y
        turn = np.arange(len(y)) % 10
        self.train, self.weigh, self.held = np.flatnonzero((turn != 4) & (turn != 9)), np.flatnonzero(turn == 4), np.flatnonzero(turn == 9)
        self.ready = all(len(np.unique(y[rows])) == 2 for rows in (self.train, self.weigh, self.held))
        self.given: list[dict[int, tuple[np.ndarray, float]]] = [{}, {}]  # of each view: text's hash -> features, label
        self.fitted: list[tuple[np.ndarray, float]] = []

    def fit(self) -> None:
        self.fitted = []
        for x, given, halves in zip(self.views, self.given, ([(0, 1 << BITS), (1 << BITS, (1 << BITS) + LAYOUT)], [(0, META)]), strict=True):
            rows = Sparse.of([*(x[i] for i in self.train), *(f for f, _ in given.values())])
            y = np.concatenate((self.y[self.train], [k for _, k in given.values()]))
            weights, biases = zip(*(fit_view(rows.part(lo, hi), y, hi - lo) for lo, hi in halves), strict=True)
            if len(halves) > 1:
                test = Sparse.of([x[i] for i in self.weigh])
                z = [test.part(lo, hi).dot(w) + b for (lo, hi), w, b in zip(halves, weights, biases, strict=True)]
                *mix, c = calibrate(np.column_stack(z), self.y[self.weigh])
                weights, biases = [m * w for m, w in zip(mix, weights, strict=True)], [sum(m * b for m, b in zip(mix, biases, strict=True)) + c]
            self.fitted.append((np.concatenate(weights), float(sum(biases))))
        z = [Sparse.of([x[i] for i in self.held]).dot(w) + b for x, (w, b) in zip(self.views, self.fitted, strict=True)]
        self.logits = np.column_stack(z)

    def judges(self) -> list[tuple[np.ndarray, float, np.ndarray]]:
        """Weights, intercept and calibration of each view."""
        return [(w, b, calibrate(self.logits[:, [v]], self.y[self.held])) for v, (w, b) in enumerate(self.fitted)]

    def most(self, kind: int) -> int:
        share = self.y.mean()
        return max(1, int(GIVEN * (share if kind else 1 - share)))

    def model(self) -> Model:
        (w, b), (mw, mb) = self.fitted
        return Model(w, b, mw, mb, calibrate(self.logits, self.y[self.held]))


def _packed(t: np.ndarray) -> bytes:
    """Gaps of ascending numbers, byte by byte of each: they compress well."""
    return np.diff(t, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<i4").ravel(), dtype=np.int32)


def _featured(docs: DataFrame) -> DataFrame:
    """did, key (of the row's content), rk (of its text) and the packed features of both views."""
    schema = pa.schema([("did", pa.int64()), ("key", pa.int64()), ("rk", pa.int64()), ("t", pa.binary()), ("m", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            meta = zip(*(b.column(i).to_pylist() for i in (4, 5, 6)), strict=True)
            rows = {"did": b.column(0), "key": b.column(1), "rk": b.column(2), "t": [_packed(text_view(y)) for y in blobs(b, "text")], "m": [_packed(meta_view(*y)) for y in meta]}
            yield from arrow_rows(rows, schema)

    did, text, lang, source, n = F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")
    rows = docs.select(did.alias("did"), F.xxhash64(did, text, lang, source, n).alias("key"), F.xxhash64(text).alias("rk"), text.alias("text"), lang.alias("lang"), source.alias("source"), n.alias("n_chars"))
    return rows.mapInArrow(run, "did long, key long, rk long, t binary, m binary")


_SURE = np.dtype([("sure", "<f8"), ("key", "<i8"), ("rk", "<i8")])


def _surest(a: np.ndarray, most: int) -> np.ndarray:
    """The first rows by surety (then key), one of each text."""
    a = a[np.lexsort((a["key"], -a["sure"]))]
    return a[np.sort(np.unique(a["rk"], return_index=True)[1])][:most]


def choose(feats: DataFrame, heads: dict[str, Head], labelled: np.ndarray) -> dict[tuple[str, int, int], np.ndarray]:
    """(question, view, kind) -> the documents, of all but the labelled, that this view is surest of and may give."""
    spark = feats.sparkSession
    judges = {name: (h.judges(), [h.most(k) for k in (0, 1)], [np.fromiter(g, np.int64, len(g)) for g in h.given]) for name, h in heads.items()}
    shared = spark.sparkContext.broadcast((judges, labelled))
    limits = {(name, v, k): most[k] for name, (_, most, _) in judges.items() for v in (0, 1) for k in (0, 1)}

    def merged(a: dict, b: dict) -> dict:
        return {g: _surest(np.concatenate([x[g] for x in (a, b) if g in x]), limits[g]) for g in a.keys() | b.keys()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges, labelled = shared.value
        top: dict = {}
        for b in it:
            key, rk = ints(b, "key"), ints(b, "rk")
            free = ~np.isin(b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), labelled)
            views = [Sparse.of([_unpacked(x) for x in b.column(c).to_pylist()]) for c in (3, 4)]
            found = {}
            for name, (both, _, given) in judges.items():
                for v, (w, bias, mix) in enumerate(both):
                    p = _sigmoid(mix[0] * (views[v].dot(w) + bias) + mix[1])
                    fresh = free & ~np.isin(rk, given[1 - v])
                    for kind, sure in enumerate((1 - p, p)):
                        at = np.flatnonzero(fresh & (sure >= SURE))
                        rows = np.empty(len(at), _SURE)
                        rows["sure"], rows["key"], rows["rk"] = np.round(sure[at], 9), key[at], rk[at]
                        found[name, v, kind] = rows
            top = merged(top, found)
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(top)], pa.binary())], names=["top"])

    tops = feats.mapInArrow(run, "top binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    out = tops.treeAggregate({}, merged, merged)
    shared.destroy()
    return out


def train(docs: DataFrame, labels: DataFrame) -> dict[str, Model | None]:
    """Models of `quality` (good) and `toxic`."""
    small_batches(docs.sparkSession)
    by = F.xxhash64(F.col("did"), F.lit(7))
    seen = labels.where("doc_id is not null and quality is not null and toxic is not null")
    seen = seen.groupBy(F.col("doc_id").cast("long").alias("did")).agg(F.max(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    # the labelled sample is bounded by a parameter
    sample = cut(seen.orderBy(by, "did").limit(LABELLED), "sample")
    names = ("quality", "toxic")
    if sample.isEmpty():
        return dict.fromkeys(names)
    feats = cut(_featured(docs), "features")
    got = feats.join(F.broadcast(sample), "did").select("did", *names, "t", "m").collect()
    got = sorted({r.did: r for r in sorted(got, key=lambda r: (r.did, bytes(r.t)))}.values(), key=lambda r: xxh32_intdigest(str(r.did).encode()))
    views = [[_unpacked(r[c]) for r in got] for c in ("t", "m")]
    heads = {name: Head(views, np.array([float(r[name] > 0) for r in got])) for name in names}
    labelled = np.array([r.did for r in got], np.int64)
    del got
    ready = {name: h for name, h in heads.items() if h.ready}
    for rnd in range(ROUNDS + 1 if ready else 0):
        for h in ready.values():
            h.fit()
        if rnd == ROUNDS:
            break
        chosen = choose(feats, ready, labelled)
        keys = {int(k) for rows in chosen.values() for k in rows["key"]}
        if not keys:
            break
        wanted = docs.sparkSession.createDataFrame([(k,) for k in sorted(keys)], "key long")
        more = {r.key: (_unpacked(r.t), _unpacked(r.m)) for r in feats.join(F.broadcast(wanted), "key").dropDuplicates(["key"]).select("key", "t", "m").collect()}
        for (name, v, kind), rows in sorted(chosen.items(), key=lambda x: x[0]):
            ready[name].given[1 - v] |= {int(r["rk"]): (more[int(r["key"])][1 - v], float(kind)) for r in rows}
    drop(feats)
    drop(sample)
    return {name: h.model() if h.ready else None for name, h in heads.items()}


def _judged(b: pa.RecordBatch, good: Model | None, toxic: Model | None) -> tuple[list, list, list]:
    """p_quality, p_toxic and kept of each row."""
    q, x_ = [], []
    for x, *meta in zip(blobs(b, "text"), *(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lang", "source", "n_chars")), strict=True):
        t, m = text_view(x or b""), meta_view(*meta)
        q.append(round(good.score(t, m), 6) if good else 0.5)
        x_.append(round(toxic.score(t, m), 6) if toxic else 0.5)
    return q, x_, [a >= REJECT and (toxic is None or c < REJECT) for a, c in zip(q, x_, strict=True)]


def scored(docs: DataFrame, models: dict[str, Model | None]) -> DataFrame:
    """doc_id, did, rk, p_quality, p_toxic, kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("rk", pa.int64()), ("p_quality", pa.float64()), ("p_toxic", pa.float64()), ("kept", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, toxic = shared.value["quality"], shared.value["toxic"]
        for b in it:
            q, x_, kept = _judged(b, good, toxic)
            yield from arrow_rows({"doc_id": b.column(0), "did": b.column(1), "rk": b.column(2), "p_quality": q, "p_toxic": x_, "kept": kept}, schema)

    did, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = docs.select(did.alias("doc_id"), F.coalesce(did, F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("rk"), text.alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, "doc_id long, did long, rk long, p_quality double, p_toxic double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; without labels, all stay."""
    shared = spark.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")))
    return filtered(docs, lambda: lambda b: _judged(b, shared.value["quality"], shared.value["toxic"])[2])


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("did", "rk")


QUERIES = {"op1_co_training": op1_co_training}
