"""Statistics over columns that the caller names: correlation matrices and their loss, tests, divergences, histograms."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftforge.functions.running import average_ranks, running
from driftforge.functions.twin import Twins


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def pearson(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """a, b, r for every pair of columns, in one pass; null where a column does not vary."""
    pairs = list(combinations(cols or numeric_columns(df), 2))
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def ranked(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns replaced by their average ranks; each rank table has one row a distinct value."""
    for c in cols:
        ranks = average_ranks(df, c).select(F.col("value").alias(c), F.col("rank").alias(f"__r_{c}"))
        df = df.join(ranks, c, "left")
    return df.select(*[F.col(f"__r_{c}").alias(c) for c in cols])


def spearman(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or numeric_columns(df)
    return pearson(ranked(df.select(*cols), cols), cols)


def correlation_loss(real: DataFrame, fake: DataFrame) -> DataFrame:
    """Of two matrices (a, b, r): mean_loss and sum_loss of the absolute differences over the full symmetric matrix but its diagonal."""
    both = real.alias("x").join(fake.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b")))
    diff = F.abs(F.coalesce("x.r", F.lit(0.0)) - F.coalesce("y.r", F.lit(0.0)))
    return both.agg(F.avg(diff).alias("mean_loss"), F.sum(2 * diff).alias("sum_loss"))


def relative_correlation(df: DataFrame, targets: list[str], by: list[str], ranks: bool = False) -> DataFrame:
    """a, b, r of each target column with each other column: vector pairs rather than a square matrix."""
    rows = ranked(df.select(*targets, *by), [*targets, *by]) if ranks else df
    one = rows.agg(*[F.corr(a, b).alias(f"r{i}_{k}") for i, a in enumerate(targets) for k, b in enumerate(by)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}_{k}").alias("r")) for i, a in enumerate(targets) for k, b in enumerate(by)]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def ks_two_sample(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """ks, p: the largest gap of the two empirical distributions, and Kolmogorov's limit of its p-value."""
    sides = a.select(F.col(col).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(col).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = sides.where("x is not null").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gaps = running(counts, "x", {"ca": "a", "cb": "b"}).join(F.broadcast(n), F.lit(True))
    found = gaps.groupBy("na", "nb").agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"))
    t = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("ks")
    tail = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * t * t) for k in range(1, 101)), F.lit(0.0))
    return found.select("ks", F.when(t < 0.2, 1.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))).alias("p"))


def softmax_kl(p: DataFrame, q: DataFrame, on: str) -> DataFrame:
    """KL divergence of softmax(p) from softmax(q), both with columns (on, p)."""
    both = p.select(on, F.col("p").alias("a")).join(q.select(on, F.col("p").alias("b")), on, "full").na.fill(0.0, ["a", "b"])
    z = both.agg(F.sum(F.exp("a")).alias("za"), F.sum(F.exp("b")).alias("zb"))
    part = F.exp("a") / F.col("za") * ((F.col("a") - F.log("za")) - (F.col("b") - F.log("zb")))
    return both.join(F.broadcast(z), F.lit(True)).agg(F.sum(part).alias("kl"))


def split_outliers(df: DataFrame, col: str, rule: str = "iqr", z: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by the quartile rule, or by mean and population deviation (z = 2 covers 95.45 %). Nulls are removed."""
    if rule == "iqr":
        q = df.agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select((F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("__lo"), (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("__hi"))
    else:
        q = df.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s")).select((F.col("m") - z * F.col("s")).alias("__lo"), (F.col("m") + z * F.col("s")).alias("__hi"))
    rows = df.join(F.broadcast(q), F.lit(True)).withColumn("__in", F.coalesce(F.col(col).between(F.col("__lo"), F.col("__hi")), F.lit(False)))
    return rows.where("__in").drop("__lo", "__hi", "__in"), rows.where("not __in").drop("__lo", "__hi", "__in")


def soft_histogram(df: DataFrame, col: str, bins: int = 20, low: float = -10.0, high: float = 10.0, width: float | None = None) -> DataFrame:
    """bin, center, p: a histogram with a Gaussian kernel of the given width; every row adds to every bin, in one pass."""
    step = (high - low) / bins
    width = width or step
    centers = [low + (i + 0.5) * step for i in range(bins)]
    mass = [F.sum(F.exp(-0.5 * ((F.col(col) - c) / width) ** 2) / (width * math.sqrt(2 * math.pi))).alias(f"m{i}") for i, c in enumerate(centers)]
    one = df.agg(*mass)
    total = sum((F.col(f"m{i}") for i in range(bins)), F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(c).alias("center"), (F.col(f"m{i}") / total).alias("p")) for i, c in enumerate(centers)])
    return one.select(F.explode(cells).alias("x")).select("x.*")


T = Twins()
_t = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


_PAIRS = list(combinations(_COLS, 2))
_CELLS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM {{t}}" for a, b in _PAIRS)
_MAT = f"WITH v AS ({_CELLS}), c AS (SELECT a, b, x - avg(x) OVER (PARTITION BY a, b) AS x, y - avg(y) OVER (PARTITION BY a, b) AS y FROM v) SELECT a, b, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS r FROM c GROUP BY a, b"
T.frame("pearson_matrix", lambda s, d: _round(pearson(_t(s, d, "lineitem"), _COLS), "r"), f"SELECT a, b, round(r, 6) AS r FROM ({_MAT.format(t='lineitem')}) m")
_SP = ["p_size", "p_retailprice", "p_partkey"]
_RK = ", ".join(f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) AS {c}" for c in _SP)
T.frame("spearman_matrix", lambda s, d: _round(spearman(_t(s, d, "part"), _SP), "r"), f"WITH r AS (SELECT {_RK} FROM part) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM r" for a, b in combinations(_SP, 2)))
_HALF = "(SELECT * FROM lineitem WHERE l_linenumber {o} 3)"
T.frame("corr_loss", lambda s, d: _round(correlation_loss(pearson(_t(s, d, "lineitem").where("l_linenumber <= 3"), _COLS), pearson(_t(s, d, "lineitem").where("l_linenumber > 3"), _COLS)), "mean_loss", "sum_loss"), f"WITH x AS ({_MAT.format(t=_HALF.format(o='<='))}), y AS ({_MAT.format(t=_HALF.format(o='>'))}) SELECT round(avg(abs(x.r - y.r)), 6) AS mean_loss, round(2 * sum(abs(x.r - y.r)), 6) AS sum_loss FROM x JOIN y USING (a, b)")
T.frame("pearson_rel", lambda s, d: _round(relative_correlation(_t(s, d, "lineitem"), ["l_extendedprice"], ["l_quantity", "l_tax"]), "r"), "SELECT 'l_extendedprice' AS a, 'l_quantity' AS b, round(covar_pop(l_extendedprice, l_quantity) / (stddev_pop(l_extendedprice) * stddev_pop(l_quantity)), 6) AS r FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(covar_pop(l_extendedprice, l_tax) / (stddev_pop(l_extendedprice) * stddev_pop(l_tax)), 6) FROM lineitem")
T.frame("spearman_rel", lambda s, d: _round(relative_correlation(_t(s, d, "part"), ["p_retailprice"], ["p_size"], True), "r"), f"WITH r AS (SELECT {_RK} FROM part) SELECT 'p_retailprice' AS a, 'p_size' AS b, round(corr(p_retailprice, p_size), 6) AS r FROM r")
_KS = """WITH c AS (SELECT o_totalprice AS x, o_orderstatus = 'O' AS a, cume_dist() OVER (PARTITION BY o_orderstatus = 'O' ORDER BY o_totalprice) AS f FROM orders),
g AS (SELECT x, max(CASE WHEN a THEN f END) AS fa, max(CASE WHEN NOT a THEN f END) AS fb FROM c GROUP BY x),
z AS (SELECT abs(coalesce(last_value(fa IGNORE NULLS) OVER w, 0) - coalesce(last_value(fb IGNORE NULLS) OVER w, 0)) AS gap FROM g WINDOW w AS (ORDER BY x))
SELECT round(max(gap), 9) AS ks FROM z"""
T.frame("ks_stat", lambda s, d: ks_two_sample(_t(s, d, "orders").where("o_orderstatus = 'O'"), _t(s, d, "orders").where("o_orderstatus <> 'O'"), "o_totalprice").select(F.round("ks", 9).alias("ks")), _KS)
_half = lambda s, d, o: _t(s, d, "part").where(f"p_size {o} 25")


def _kl(s, d):
    from driftforge.operators.distributions import categorical

    return _round(softmax_kl(categorical(_half(s, d, "<="), "p_brand"), categorical(_half(s, d, ">"), "p_brand"), "value"), "kl", digits=9)


T.frame("kl_div", _kl, "WITH c AS (SELECT p_brand AS v, count(*) FILTER (p_size <= 25) / (SELECT count(*) FROM part WHERE p_size <= 25) AS a, count(*) FILTER (p_size > 25) / (SELECT count(*) FROM part WHERE p_size > 25) AS b FROM part GROUP BY 1), s AS (SELECT exp(a) / sum(exp(a)) OVER () AS p, exp(b) / sum(exp(b)) OVER () AS q FROM c) SELECT round(sum(p * ln(p / q)), 9) AS kl FROM s")
T.frame("iqr_filter", lambda s, d: _sides(*split_outliers(_t(s, d, "events"), "value"), "value"), "WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), r AS (SELECT value, value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS kept FROM events, q) SELECT kept, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM r GROUP BY kept")
T.frame("ci_filter", lambda s, d: _sides(*split_outliers(_t(s, d, "orders"), "o_totalprice", "ci"), "o_totalprice"), "WITH m AS (SELECT avg(o_totalprice) AS mu, sqrt(avg(o_totalprice * o_totalprice) - avg(o_totalprice) * avg(o_totalprice)) AS sd FROM orders), r AS (SELECT o_totalprice AS v, abs(o_totalprice - mu) <= 2 * sd AS kept FROM orders, m) SELECT kept, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high FROM r GROUP BY kept")
T.frame("soft_histogram", lambda s, d: _round(soft_histogram(_t(s, d, "customer").select((F.col("c_acctbal") / 1000).alias("x")), "x"), "p"), "WITH k AS (SELECT CAST(unnest(range(0, 20)) AS INT) AS bin), m AS (SELECT bin, bin - 9.5 AS center, sum(exp(-0.5 * pow(c_acctbal / 1000 - (bin - 9.5), 2))) AS w FROM customer CROSS JOIN k GROUP BY bin) SELECT bin, CAST(center AS DOUBLE) AS center, round(w / sum(w) OVER (), 6) AS p FROM m")


def _sides(kept: DataFrame, removed: DataFrame, col: str) -> DataFrame:
    rows = kept.select(F.lit(True).alias("kept"), F.col(col).alias("v")).union(removed.select(F.lit(False), F.col(col)))
    return rows.groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"))


QUERIES, ORACLES = T.queries, T.oracles
