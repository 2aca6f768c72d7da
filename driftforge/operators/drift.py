"""Solve for a target distribution at a set Jensen-Shannon distance, and resample tables, workloads and key sets to it.

The path from p goes first to the far end of its mode (Zipf for skew, uniform for flatten) and then on to the rarest
bin alone; the first point at the wanted distance is the target. Draws come from hashes of the row's key, so they are
the same under any partitioning; a row finds its bin in a cumulative table of bins, which is bounded by the bin count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftforge.functions.twin import Twins
from driftforge.operators.distributions import categorical

MOST = math.sqrt(math.log(2))


def zipf(n: int, s: float = 1.0) -> np.ndarray:
    w = 1.0 / np.arange(1, n + 1) ** s
    return w / w.sum()


def js(p: np.ndarray, q: np.ndarray) -> float:
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log(p / m), 0) + np.where(q > 0, q * np.log(q / m), 0)
    return math.sqrt(max(0.0, part.sum() / 2))


def solve(p: Sequence[float], d: float, skewed: bool = True) -> tuple[np.ndarray, bool]:
    """p in order of falling frequency. (q, feasible): q at distance d, or the end of the path if none is that far."""
    p = np.asarray(p, float)
    if d <= 0 or len(p) < 2:
        return p, d <= 0
    end, last = (zipf(len(p)) if skewed else np.full(len(p), 1 / len(p))), np.eye(len(p))[-1]
    at = lambda s: (1 - s) * p + s * end if s <= 1 else (2 - s) * end + (s - 1) * last
    grid = np.linspace(0, 2, 513)
    far = next((i for i, s in enumerate(grid) if js(p, at(s)) >= d), None)
    if far is None:
        return at(2.0), False
    low, high = grid[max(0, far - 1)], grid[far]
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if js(p, at(mid)) >= d else (mid, high)
    return at(high), True


def uniform(key, salt: str):
    """U[salt:key] as a column."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")) if isinstance(key, str) else key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


#: Categories of a column that may be drifted as such; more are an error.
MOST_BINS = 10_000


def few_categories(df: DataFrame, col: str) -> list:
    """Rows (value, cnt, p, ord) of a column's categories in order of falling frequency."""
    rows = categorical(df, col).orderBy("ord").limit(MOST_BINS + 1).collect()
    if len(rows) > MOST_BINS:
        raise ValueError(f"{col} has more than {MOST_BINS} categories: bin it first")
    return rows


def place_of(u, q: Sequence[float]):
    """The number of the bin, by the cumulative shares q, that a uniform number falls into: no join."""
    edges = np.cumsum(q)[:-1].tolist()
    if len(edges) <= 100:
        return sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= u))


def resample_categorical(df: DataFrame, col: str, key: str, d: float, skewed: bool = True, salt: str = "42") -> DataFrame:
    """key, new value: every row draws from the target."""
    rows = few_categories(df, col)
    if not rows:
        return df.select(key, col)
    q, _ = solve([r.p for r in rows], d, skewed)
    values = F.array(*[F.lit(r.value) for r in rows])
    return df.select(key, F.element_at(values, place_of(uniform(key, salt), q) + 1).alias(col))


def drawn_in_bins(u, q: Sequence[float], starts: Sequence, ends: Sequence, whole: bool, v):
    """A value of the bin that u falls into, by a second uniform number v: whole numbers of (start, end], else start to end."""
    at = place_of(u, q) + 1
    a, b = F.element_at(F.array(*map(F.lit, starts)), at), F.element_at(F.array(*map(F.lit, ends)), at)
    return F.least(a + 1 + F.floor(v * (b - a)), b) if whole else a + v * (b - a)


def ladder(df: DataFrame, col: str, distances: Sequence[float], fractions: Sequence[float], skewed: bool = True) -> DataFrame:
    """d, f, value, avail, taken, feasible: for each distance and fraction, how many rows of each bin a sample without
    replacement takes: the solved share of the fraction, as far as there are rows."""
    rows = few_categories(df, col)
    n = sum(r.cnt for r in rows)
    out = []
    for d in distances:
        q, ok = solve([r.p for r in rows], d, skewed)
        out += [(float(d), float(f), r.value, r.cnt, min(int(x * f * n), r.cnt), bool(ok)) for f in fractions for r, x in zip(rows, q.tolist(), strict=True)]
    return df.sparkSession.createDataFrame(out, f"d double, f double, value {df.schema[col].dataType.simpleString()}, avail long, taken long, feasible boolean")


def delete_ids(df: DataFrame, key: str, ids: DataFrame, chunks: int = 1) -> DataFrame:
    """df without the rows whose key is listed; in chunks by hash of the key, each an anti join of its own."""
    ids = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    mine = lambda c: F.pmod(F.xxhash64(key), F.lit(chunks)) == c
    return reduce(DataFrame.union, [df.where(mine(c) | (F.col(key).isNull() if c == 0 else F.lit(False))).join(ids.where(mine(c)), key, "left_anti").select(*df.columns) for c in range(chunks)])


def quota_sample(df: DataFrame, bin_col: str, key: str, quota: dict, salt: str = "42") -> DataFrame:
    """Without replacement: of each bin the quota rows of least draw; exact counts, no draw repeated."""
    bins = df.sparkSession.createDataFrame(list(quota.items()), f"{bin_col} {df.schema[bin_col].dataType.simpleString()}, quota long")
    order = Window.partitionBy(bin_col).orderBy("u", key)
    return df.join(F.broadcast(bins), bin_col).withColumn("u", uniform(key, salt)).withColumn("n", F.row_number().over(order)).where("n <= quota").drop("u", "n", "quota")


def chain(df: DataFrame, step: Callable[[DataFrame, int], DataFrame], times: int) -> DataFrame:
    """The output of one drift is the input of the next."""
    for i in range(times):
        df = step(df, i)
    return df


T = Twins()
_PATH = """c AS (SELECT o_orderpriority AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders GROUP BY 1),
z AS (SELECT value, k, cnt / (SELECT sum(cnt) FROM c) AS p, {end} AS e, CASE WHEN k = (SELECT max(k) FROM c) THEN 1e0 ELSE 0e0 END AS l FROM c),
st AS (SELECT n / 256e0 AS s FROM {steps}),
path AS (SELECT s, value, k, p, CASE WHEN s <= 1 THEN (1 - s) * p + s * e ELSE (2 - s) * e + (s - 1) * l END AS q FROM z CROSS JOIN st),
dist AS (SELECT s, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js FROM path GROUP BY s),
best AS (SELECT min(s) AS s FROM dist WHERE js >= {d}),
q AS (SELECT value, k, p, q, sum(q) OVER (ORDER BY k) - q AS lo, sum(q) OVER (ORDER BY k) AS hi FROM path JOIN best ON path.s = best.s)"""
_ZIPF, _FLAT = "(1e0 / k) / (SELECT sum(1e0 / k) FROM c)", "1e0 / (SELECT count(*) FROM c)"
_ST, _DT = "(SELECT explode(sequence(0, 512)) AS n) g", "(SELECT unnest(range(0, 513)) AS n) g"


def _path(end: str, d: float, steps: str) -> str:
    return "WITH " + _PATH.format(end=end, d=d, steps=steps)


for _name, _end, _d in (("drift_solve_skew", _ZIPF, 0.2), ("drift_solve_flat", _FLAT, 0.3)):
    _tail = " SELECT value, round(p, 9) AS p, round(q, 9) AS q FROM q"
    T.both(_name, _path(_end, _d, _ST) + _tail, _path(_end, _d, _DT) + _tail)
_tail = ", r AS (SELECT o_orderkey, U['42:' || o_orderkey] AS u FROM orders), n AS (SELECT q.value, count(*) AS cnt FROM r JOIN q ON r.u >= q.lo AND r.u < q.hi GROUP BY 1) SELECT value, cnt, round(cnt / (SELECT count(*) FROM orders), 9) AS realised FROM n"
T.both("sample_iid", _path(_ZIPF, 0.3, _ST) + _tail, _path(_ZIPF, 0.3, _DT) + _tail)
_tail = ", t AS (SELECT count(*) AS n FROM orders), g AS (SELECT value, CAST(floor(hi * n + 1e-9) AS BIGINT) - CAST(floor(lo * n + 1e-9) AS BIGINT) AS cnt, p FROM q CROSS JOIN t) SELECT value, cnt, round(p, 9) AS p FROM g"
T.both("sample_quota", _path(_ZIPF, 0.3, _ST) + _tail, _path(_ZIPF, 0.3, _DT) + _tail)
_tail = ", t AS (SELECT count(*) AS n FROM orders), g AS (SELECT value, (floor(hi * n + 1e-9) - floor(lo * n + 1e-9)) / n AS r, p FROM q CROSS JOIN t) SELECT round(sqrt(greatest(sum(p * ln(2 * p / (p + r)) + CASE WHEN r > 0 THEN r * ln(2 * r / (p + r)) ELSE 0 END) / 2, 0)), 6) AS realised_js, count(*) AS bins FROM g"
T.both("drift_slice_orderpriority", _path(_ZIPF, 0.3, _ST) + _tail, _path(_ZIPF, 0.3, _DT) + _tail)
T.both("zipf_pmf", "SELECT k, round((1e0 / k) / (SELECT sum(1e0 / k) FROM (SELECT explode(sequence(1, 20)) AS k) a), 12) AS zipf, 1e0 / 20 AS uniform FROM (SELECT explode(sequence(1, 20)) AS k) b", "SELECT CAST(k AS INT) AS k, round((1e0 / k) / (SELECT sum(1e0 / k) FROM (SELECT unnest(range(1, 21)) AS k) a), 12) AS zipf, 1e0 / 20 AS uniform FROM (SELECT unnest(range(1, 21)) AS k) b")
_NUM = "WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part), r AS (SELECT p_partkey, CAST(floor(U['7:' || p_partkey] * 5) AS INT) AS bin, U['8:' || p_partkey] AS v FROM part) SELECT bin, count(*) AS cnt, min(CAST(floor(lo + (bin + v) * (hi - lo + 1) / 5) AS INT)) AS low, max(CAST(floor(lo + (bin + v) * (hi - lo + 1) / 5) AS INT)) AS high FROM r CROSS JOIN b GROUP BY bin"
T.both("sample_numeric", _NUM)
_KEYS = "WITH k AS (SELECT DISTINCT event_id AS key FROM events), r AS (SELECT key, CAST(floor(key / 1024e0) AS BIGINT) AS bin, row_number() OVER (PARTITION BY floor(key / 1024e0) ORDER BY md5('42:' || key), key) AS n FROM k), g AS (SELECT bin, count(*) AS avail FROM r GROUP BY bin), want AS (SELECT bin, avail, CAST(floor(avail * (0.2e0 + 0.15e0 * (bin % 7))) AS BIGINT) AS quota FROM g), bulk AS (SELECT key, r.bin FROM r JOIN want ON r.bin = want.bin WHERE n <= quota)"
T.both("keyset_bulk", _KEYS + " SELECT bin, count(*) AS cnt, min(key) AS first_key, max(key) AS last_key FROM bulk GROUP BY bin")
T.both("keyset_insert", _KEYS + " SELECT count(*) AS inserts, min(k.key) AS first_key, max(k.key) AS last_key FROM k LEFT JOIN bulk ON k.key = bulk.key WHERE bulk.key IS NULL")
T.both("keyset_exceed", _KEYS + " SELECT sum(CASE WHEN quota * 2 > avail THEN 1e0 ELSE 0e0 END) AS exceeded, sum(least(quota * 2, avail)) AS taken FROM want", _KEYS + " SELECT sum(CASE WHEN quota * 2 > avail THEN 1e0 ELSE 0e0 END) AS exceeded, CAST(sum(least(quota * 2, avail)) AS BIGINT) AS taken FROM want")
T.both("bernoulli_delete", "SELECT o_orderstatus, count(*) AS kept FROM orders WHERE U['d:' || o_orderkey] >= 0.5 GROUP BY 1")
T.both("card_compare", "WITH full_c AS (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem), half AS (SELECT 'orders' AS t, count(*) AS n FROM orders WHERE U['d:' || o_orderkey] >= 0.5 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE U['d:' || l_orderkey] >= 0.5) SELECT f.t, f.n, h.n AS n_half, f.n - h.n AS diff, round((f.n - h.n) / f.n, 8) AS rel_diff FROM full_c f JOIN half h ON f.t = h.t")
T.both("pk_weights", "SELECT c_custkey, coalesce(w, 0e0) AS weight FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS w FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON c_custkey = o_custkey")
T.both("resample_chunks", "WITH i AS (SELECT explode(sequence(0, 499)) AS i), n AS (SELECT count(*) AS n FROM nation), d AS (SELECT i, CAST(floor(i / 25e0) AS BIGINT) AS chunk, CAST(floor(U['w:' || i] * n) AS INT) AS pick FROM i CROSS JOIN n) SELECT chunk, count(*) AS cnt, count(DISTINCT pick) AS picks FROM d GROUP BY chunk", "WITH i AS (SELECT unnest(range(0, 500)) AS i), n AS (SELECT count(*) AS n FROM nation), d AS (SELECT i, CAST(floor(i / 25e0) AS BIGINT) AS chunk, CAST(floor(U['w:' || i] * n) AS INT) AS pick FROM i CROSS JOIN n) SELECT chunk, count(*) AS cnt, count(DISTINCT pick) AS picks FROM d GROUP BY chunk")
T.both("keep_last_run", "SELECT user_id, max_by(value, event_id) AS last_value, count(*) AS runs FROM events GROUP BY user_id")
T.frame("drift_ladder", lambda s, d: ladder(s.read.parquet(f"{d}/customer.parquet"), "c_mktsegment", [0.1, 0.3, 0.5, 0.7], [0.5, 0.6, 0.8, 1.0]))


def _chained(s, d):
    """Twice drifted, first skewed, then flattened: the share of each value after either step."""
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority")
    first = chain(o, lambda df, i: resample_categorical(df, "o_orderpriority", "o_orderkey", 0.3, True, "c0"), 1)
    both = chain(o, lambda df, i: resample_categorical(df, "o_orderpriority", "o_orderkey", (0.3, 0.1)[i], i == 0, f"c{i}"), 2)
    return reduce(DataFrame.union, [categorical(df, "o_orderpriority").select(F.lit(i).alias("step"), "value", "cnt", "p") for i, df in enumerate((o, first, both))])


T.frame("drift_chain", _chained)
T.frame("delete_chunks", lambda s, d: delete_ids(s.read.parquet(f"{d}/orders.parquet"), "o_orderkey", s.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 45").select("l_orderkey"), 4).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1")
QUERIES, ORACLES = T.queries, T.oracles
