"""Distributions of columns and key sets: categories, bins, predefined bins, key bins, cumulative shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftforge.functions.running import shares
from driftforge.functions.twin import Twins


def categorical(df: DataFrame, col: str) -> DataFrame:
    """value, cnt, p; nulls are left out, most frequent first by ord (ties by value)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("n"))
    order = Window.orderBy(F.desc("cnt"), F.asc("value"))  # of the categories, not the rows
    return counts.join(F.broadcast(total), F.lit(True)).select("value", "cnt", (F.col("cnt") / F.col("n")).alias("p"), F.row_number().over(order).alias("ord"))


def categorical_on(df: DataFrame, col: str, values: list) -> DataFrame:
    """Predefined categories, absent ones with 0; the share is of all rows, nulls and others included."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(v,) for v in values], df.select(F.col(col).alias("value")).schema)
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "value", "left").join(F.broadcast(total), F.lit(True)).select("value", F.coalesce("cnt", F.lit(0)).alias("cnt"), (F.coalesce("cnt", F.lit(0)) / F.col("n")).alias("p"))


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Number (from 0) of the right-closed equal-width bin; the lowest value belongs to the first."""
    at = F.ceil((x - low) * bins / (high - low)) - 1
    return F.when(high == low, F.lit(0)).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))).cast("int")


def equi_width(df: DataFrame, col: str, bins: int) -> DataFrame:
    """bin, cnt, p of a float column; one pass for the bounds, one for the counts. The share is of all rows, nulls included."""
    x = F.col(col).cast("double")
    good = x.isNotNull() & ~F.isnan(x)
    edges = df.agg(F.min(F.when(good, x)).alias("low"), F.max(F.when(good, x)).alias("high"), F.count(F.lit(1)).alias("n"))
    found = df.where(good).select(x.alias("x")).join(F.broadcast(edges), F.lit(True)).groupBy(bin_of(F.col("x"), F.col("low"), F.col("high"), bins).alias("bin"), "n")
    return found.agg(F.count(F.lit(1)).alias("cnt")).select("bin", "cnt", (F.col("cnt") / F.col("n")).alias("p"))


def int_edges(low: int, high: int, bins: int) -> list[int]:
    """Whole edges of equal width, cut towards zero; too few different ones are an error."""
    edges = sorted({int(low + (high - low) * i / bins) for i in range(bins + 1)})
    if len(edges) <= bins:
        raise ValueError(f"{low} to {high} gives {len(edges) - 1} whole bins, not {bins}")
    return edges


def int_equi_width(df: DataFrame, col: str, bins: int) -> DataFrame:
    """bin, start, end, cnt, p of an integer column: right-closed bins between whole edges, the least value in the first."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, start long, end long, cnt long, p double")
    edges = int_edges(low, high, bins)
    at = F.greatest(sum((F.when(F.col(col) > e, 1).otherwise(0) for e in edges), F.lit(0)) - 1, F.lit(0))
    counts = df.where(F.col(col).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    every = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, start long, end long")
    full = every.join(counts, "bin", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return full.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy()))  # of the bins


def classify(df: DataFrame, cols: list[str] | None = None, threshold: int = 20) -> DataFrame:
    """col, numeric_col: floating columns are numeric, whole ones with `threshold` different values or more; others are not."""
    kinds = dict(df.dtypes)
    cols = cols or df.columns
    whole = [c for c in cols if kinds[c] in ("tinyint", "smallint", "int", "bigint")]
    floating = lambda t: t in ("float", "double") or t.startswith("decimal")
    one = df.agg(F.lit(0).alias("x"), *[F.countDistinct(c).alias(f"n_{c}") for c in whole])
    cells = [F.struct(F.lit(c).alias("col"), (F.col(f"n_{c}") >= threshold if c in whole else F.lit(floating(kinds[c]))).alias("numeric_col")) for c in cols]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def adaptive_bins(df: DataFrame, cols: list[str], most: int = 20) -> DataFrame:
    """col, bins: one less than the different values where these are fewer than `most`."""
    one = df.agg(*[F.countDistinct(c).alias(c) for c in cols])
    cells = [F.struct(F.lit(c).alias("col"), F.when(F.col(c) < most, F.col(c) - 1).otherwise(most).alias("bins")) for c in cols]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def in_order(dist: DataFrame, by: str = "bin") -> DataFrame:
    """A distribution in the order of its bins rather than of its counts, numbered from 0 (bins are few)."""
    return dist.withColumn("place", F.row_number().over(Window.orderBy(by)) - 1)


def bin_members(keys: DataFrame, col: str, shift: int) -> DataFrame:
    """bin, key: a row for each different key, not a list for each bin, which a hot bin would not fit."""
    return keys.select(F.shiftright(F.col(col), shift).alias("bin"), F.col(col).alias("key")).distinct()


def on_intervals(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Right-closed intervals (edges[i], edges[i+1]]; rows outside are left out of the share too."""
    x = F.col(col).cast("double")
    at = sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    inside = df.where((x > edges[0]) & (x <= edges[-1])).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    return inside.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy()))


def key_bins(keys: DataFrame, col: str, shift: int) -> DataFrame:
    counts = keys.groupBy(F.shiftright(F.col(col), shift).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy()))


T = Twins()


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


_R = lambda df: df.withColumn("p", F.round("p", 9))
T.frame("dist_categorical", lambda s, d: _R(categorical(_table(s, d, "orders"), "o_orderpriority")), "SELECT o_orderpriority AS value, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 9) AS p, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS INT) AS ord FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
T.frame("dist_cat_predef", lambda s, d: _R(categorical_on(_table(s, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "ABSENT"])), "SELECT v AS value, count(c_mktsegment) AS cnt, round(count(c_mktsegment) / (SELECT count(*) FROM customer), 9) AS p FROM (VALUES ('BUILDING'), ('MACHINERY'), ('ABSENT')) b(v) LEFT JOIN customer ON c_mktsegment = v GROUP BY v")
T.frame("dist_num_predef", lambda s, d: _R(on_intervals(_table(s, d, "customer"), "c_acctbal", [-500.0, 0.0, 1000.0, 4000.0, 9000.0])), "SELECT CAST(CASE WHEN c_acctbal > 4000 THEN 3 WHEN c_acctbal > 1000 THEN 2 WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS INT) AS bin, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM customer WHERE c_acctbal > -500 AND c_acctbal <= 9000 GROUP BY 1")
T.frame("dist_keybins", lambda s, d: _R(key_bins(_table(s, d, "orders"), "o_orderkey", 8)), "SELECT o_orderkey >> 8 AS bin, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM orders GROUP BY 1")
T.both("dist_keybins_filled", "WITH b AS (SELECT DISTINCT o_orderkey, floor(o_orderkey / 700e0) AS f FROM orders), c AS (SELECT CAST(f AS BIGINT) AS bin, count(*) AS cnt FROM b GROUP BY 1), r AS (SELECT explode(sequence(min(bin), max(bin))) AS bin FROM c) SELECT r.bin, coalesce(cnt, 0) AS cnt FROM r LEFT JOIN c ON r.bin = c.bin", "WITH b AS (SELECT DISTINCT o_orderkey, floor(o_orderkey / 700e0) AS f FROM orders), c AS (SELECT CAST(f AS BIGINT) AS bin, count(*) AS cnt FROM b GROUP BY 1), r AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM c) SELECT r.bin, coalesce(cnt, 0) AS cnt FROM r LEFT JOIN c ON r.bin = c.bin")
# shares by distinct value: the window runs over the values' counts
T.both("key_unique", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_unique, count(*) = count(DISTINCT l_orderkey) AS all_unique FROM lineitem")
# the oracle counts the edges below a value, the operator computes the bin
_FLOAT = "WITH e AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders), k AS (SELECT unnest(range(1, 20)) AS k), b AS (SELECT low + k * (high - low) / 20 AS edge FROM e, k), r AS (SELECT o_orderkey, count(edge) AS bin FROM orders LEFT JOIN b ON o_totalprice > edge GROUP BY o_orderkey) SELECT CAST(bin AS INT) AS bin, count(*) AS cnt, round(count(*) / (SELECT n FROM e), 9) AS p FROM r GROUP BY 1"
T.frame("dist_float_bins", lambda s, d: _R(equi_width(_table(s, d, "orders"), "o_totalprice", 20)), _FLOAT)
_INT = "WITH e AS (SELECT min(p_size) AS low, max(p_size) AS high FROM part), b AS (SELECT DISTINCT CAST(trunc(low + i * (high - low) / 10) AS BIGINT) AS edge FROM e, (SELECT unnest(range(0, 11)) AS i)), w AS (SELECT row_number() OVER (ORDER BY edge) - 1 AS bin, edge AS start, lead(edge) OVER (ORDER BY edge) AS stop FROM b) SELECT CAST(bin AS INT) AS bin, start, stop AS end, count(p_partkey) AS cnt, round(count(p_partkey) / sum(count(p_partkey)) OVER (), 9) AS p FROM w LEFT JOIN part ON (p_size > start OR (bin = 0 AND p_size = start)) AND p_size <= stop WHERE stop IS NOT NULL GROUP BY ALL"
T.frame("dist_int_bins", lambda s, d: _R(int_equi_width(_table(s, d, "part"), "p_size", 10)), _INT.replace("GROUP BY ALL", "GROUP BY bin, start, stop"))
T.frame("dist_int_bins_ordered", lambda s, d: in_order(int_equi_width(_table(s, d, "part"), "p_size", 10)).select("bin", "place", "cnt"), _INT.replace("GROUP BY ALL", "GROUP BY bin, start, stop").replace("SELECT CAST(bin AS INT) AS bin, start, stop AS end, count(p_partkey) AS cnt, round(count(p_partkey) / sum(count(p_partkey)) OVER (), 9) AS p", "SELECT CAST(bin AS INT) AS bin, CAST(bin AS INT) AS place, count(p_partkey) AS cnt"))
T.frame("dist_bin_keys", lambda s, d: bin_members(_table(s, d, "customer"), "c_custkey", 8), "SELECT DISTINCT CAST(floor(c_custkey / 256) AS BIGINT) AS bin, c_custkey AS key FROM customer")
T.frame("dist_adaptive_bins", lambda s, d: adaptive_bins(_table(s, d, "part"), ["p_size", "p_type", "p_brand"]), " UNION ALL ".join(f"SELECT '{c}' AS col, CASE WHEN n < 20 THEN n - 1 ELSE 20 END AS bins FROM (SELECT count(*) AS n FROM (SELECT DISTINCT {c} FROM part WHERE {c} IS NOT NULL) v)" for c in ("p_size", "p_type", "p_brand")))
_KIND = "SELECT column_name AS col, data_type IN ('FLOAT', 'DOUBLE') OR (data_type IN ('INTEGER', 'BIGINT') AND n >= 20) AS numeric_col FROM (SELECT * FROM duckdb_columns() WHERE table_name = 'lineitem') c LEFT JOIN (UNPIVOT (SELECT count(DISTINCT l_orderkey) AS l_orderkey, count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_suppkey) AS l_suppkey, count(DISTINCT l_linenumber) AS l_linenumber FROM lineitem) ON COLUMNS(*) INTO NAME col VALUE n) u ON u.col = c.column_name"
T.frame("dist_classify", lambda s, d: classify(_table(s, d, "lineitem")), _KIND)
T.frame("cdf_orders", lambda s, d: shares(_table(s, d, "orders"), "o_orderdate").select(F.col("value").alias("o_orderdate"), F.round("share", 9).alias("share")), "SELECT DISTINCT o_orderdate, round(cume_dist() OVER (ORDER BY o_orderdate), 9) AS share FROM orders")
QUERIES, ORACLES = T.queries, T.oracles
