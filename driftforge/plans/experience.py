"""Analytics over executed plans: arms, best plans, regressions, pairs, cardinality swings, shapes and signatures.

Plans are orders (query: o_custkey, arm: o_orderpriority, latency: o_totalprice).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftforge.functions.running import running
from driftforge.functions.twin import Twins

BLOCK = 4096


def neighbour_distance(df: DataFrame, key: str, col: str, k: int, block: int = BLOCK) -> DataFrame:
    """id, unc: the mean distance of each row's k nearest others, or of all others where there are fewer; null without any.

    The k nearest are among the k before and the k after in sorted order. Rows are dealt by rank to blocks (of more than
    2 * k rows), those within k of an edge to the next block too. Rows without a value have no distance and are left out.
    """
    rows = df.where(F.col(col).isNotNull()).select(F.col(key).alias("id"), F.col(col).cast("double").alias("x"))
    ranked = df.sparkSession.createDataFrame(rows.orderBy("x", "id").rdd.zipWithIndex().map(lambda r: (*r[0], r[1])), rows.schema.add("rank", "long"))
    mine = F.expr(f"rank div {block}")
    dealt = ranked.withColumn("block", F.explode(F.array_distinct(F.array(mine, F.expr(f"(rank - {k}) div {block}"), F.expr(f"(rank + {k}) div {block}")))))
    around = F.collect_list("x").over(Window.partitionBy("block").orderBy("rank").rowsBetween(-k, k))
    near = dealt.withColumn("near", around).where(mine == F.col("block"))
    # the least distance, 0, is the row's own
    least = near.select("id", F.slice(F.array_sort(F.transform("near", lambda v: F.abs(v - F.col("x")))), 2, k).alias("d"))
    return least.select("id", F.round(F.aggregate("d", F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size("d"), F.lit(0)), 6).alias("unc"))


def rank_scores(df: DataFrame, query: str, key: str, col: str) -> DataFrame:
    """query, key, rk, rk2, rk4, ln_exp: the place of each plan among its query's, from 1, and the scores that training makes of it.

    Ranks beyond 55,108 are an error, as in SQL: their fourth power has no 64-bit integer. Null values come last, as there.
    """
    by = Window.partitionBy(query).orderBy(F.col(col).asc_nulls_last(), F.col(key).asc_nulls_last())
    rk = F.col("rk").cast("long")  # row_number() is an int, whose fourth power ends at rank 215
    ranked = df.select(query, key, F.row_number().over(by).alias("rk"))
    return ranked.select(query, key, "rk", (rk * rk).alias("rk2"), (rk * rk * rk * rk).alias("rk4"), F.round(F.log(F.exp(F.least(rk, F.lit(700)).cast("double"))), 6).alias("ln_exp"))


T = Twins()
_E = "WITH e AS (SELECT o_custkey AS q, o_orderpriority AS arm, o_totalprice AS lat, o_orderkey AS id FROM orders)"
T.both("exp_unexecuted", _E + ", arms AS (SELECT DISTINCT arm FROM e), qs AS (SELECT DISTINCT q FROM e) SELECT qs.q, count(*) AS missing FROM qs CROSS JOIN arms LEFT JOIN e ON e.q = qs.q AND e.arm = arms.arm WHERE e.id IS NULL GROUP BY 1")
T.both("exp_best_plan", _E + " SELECT q, min(lat) AS best, min_by(arm, lat) AS arm, count(*) AS visits FROM e GROUP BY q")
T.both("exp_regressions", _E + ", b AS (SELECT q, min(lat) AS best FROM e GROUP BY q) SELECT arm, count(*) AS regressions, round(sum(lat - best), 2) AS excess FROM e JOIN b ON e.q = b.q WHERE lat > 1.01 * best GROUP BY arm")
T.both("exp_arm_choice", _E + ", p AS (SELECT q, arm, avg(lat) AS pred FROM e GROUP BY 1, 2) SELECT arm, count(*) AS chosen FROM (SELECT q, min_by(arm, pred) AS arm FROM p GROUP BY q) x GROUP BY 1")
T.both("exp_hint_fallback", _E + ", p AS (SELECT q, min(lat) AS best, min_by(lat, id) AS base, coalesce(stddev_pop(lat), 0) / avg(lat) AS unc FROM e GROUP BY q) SELECT q, CASE WHEN best < base AND unc < 0.6 AND base > 100 THEN 'hint' ELSE 'base' END AS choice FROM p")
T.both("card_swing", "SELECT n_regionkey, f, round(count(*) * f, 6) AS card FROM nation CROSS JOIN (SELECT 0.01e0 AS f UNION ALL SELECT 0.1e0 UNION ALL SELECT 1e0 UNION ALL SELECT 10e0 UNION ALL SELECT 100e0) s GROUP BY 1, 2")
T.both("card_restore", "WITH c AS (SELECT n_regionkey AS k, count(*) * 10 AS card FROM nation GROUP BY 1), o AS (SELECT n_regionkey AS k, count(*) AS card FROM nation GROUP BY 1) SELECT c.k, coalesce(o.card, c.card) AS card FROM c LEFT JOIN o ON c.k = o.k")
T.frame("rank_score", lambda s, d: rank_scores(s.read.parquet(f"{d}/customer.parquet"), "c_nationkey", "c_custkey", "c_acctbal").drop("c_nationkey"), "WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rk FROM customer) SELECT c_custkey, CAST(rk AS INT) AS rk, CAST(rk * rk AS BIGINT) AS rk2, CAST(rk * rk * rk * rk AS BIGINT) AS rk4, round(ln(exp(CAST(least(rk, 700) AS DOUBLE))), 6) AS ln_exp FROM r")
T.both("group_plans", _E + " SELECT q, count(DISTINCT arm) AS plans FROM e GROUP BY q HAVING count(DISTINCT arm) > 1")
T.frame("knn_uncertainty", lambda s, d: neighbour_distance(s.read.parquet(f"{d}/supplier.parquet"), "s_suppkey", "s_acctbal", 10), "WITH a AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier WHERE s_acctbal IS NOT NULL), d AS (SELECT p.id, abs(p.x - n.x) AS dist, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.x - n.x), n.id) AS k FROM a p LEFT JOIN a n ON p.id <> n.id) SELECT id, round(avg(dist), 6) AS unc FROM d WHERE k <= 10 GROUP BY id")


def pairs_by_order(df: DataFrame, query: str, key: str, col: str) -> DataFrame:
    """query, pairs, first_better: how many pairs of plans a query has, and in how many the one with the lesser key has the
    lesser latency. Counted from how many smaller latencies follow each plan in blocks of ranks, not from the pairs."""
    by = Window.partitionBy(query)
    ranked = df.select(query, key, F.col(col).alias("__x")).withColumn("__k", F.row_number().over(by.orderBy(key)) - 1).withColumn("__r", F.dense_rank().over(by.orderBy("__x")))
    # a merge sort's counting: at each level rows of the same pair of halves are compared by running counts
    levels = ranked.select(query, F.explode(F.sequence(F.lit(0), F.lit(31))).alias("__l"), "__k", "__r")
    half = levels.withColumn("__g", F.expr("shiftrightunsigned(cast(__k as bigint), __l + 1)")).withColumn("__left", (F.expr("shiftrightunsigned(cast(__k as bigint), __l)") % 2 == 0).cast("int"))
    seen = F.sum("__left").over(Window.partitionBy(query, "__l", "__g").orderBy("__r").rangeBetween(Window.unboundedPreceding, -1))
    better = half.withColumn("__b", F.when(F.col("__left") == 0, F.coalesce(seen, F.lit(0))).otherwise(0)).groupBy(query).agg(F.sum("__b").alias("first_better"))
    counts = df.groupBy(query).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.join(better, query).select(query, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.col("first_better").cast("double").alias("first_better"))


def training_pairs(df: DataFrame, query: str, key: str, col: str, most: int = 1000) -> DataFrame:
    """The pairs themselves (query, a, b, better): a model's training set, for queries of at most `most` plans; others are an error."""
    many = df.groupBy(query).count().where(F.col("count") > most).limit(1).collect()
    if many:
        raise ValueError(f"{many[0][0]} has {many[0]['count']} plans, more than {most}: keep the best of them first")
    a, b = (df.select(query, F.col(key).alias(k), F.col(col).alias(f"x{k}")) for k in ("a", "b"))
    return a.join(b, query).where("a < b").select(query, "a", "b", (F.col("xa") < F.col("xb")).alias("better"))


def buffer_state(pages: DataFrame, rel: str, page: str) -> DataFrame:
    """rel, pages: different pages of each relation that a cache holds."""
    return pages.groupBy(rel).agg(F.countDistinct(page).alias("pages"))


def experiment_results(queries: DataFrame, links: DataFrame, runs: DataFrame) -> DataFrame:
    """query, results: the runs of each experiment in order of arm, from queries (query_id, query), links (run_id, query_id, arm) and runs (run_id, reward)."""
    rows = links.join(runs, "run_id").join(queries, "query_id")
    return rows.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("arm", "run_id", "reward"))).alias("results"))


def _results(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    q = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("query"))
    found = experiment_results(q, o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("arm")), o.select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("reward")))
    return found.select("query_id", "query", F.size("results").alias("n"), F.array_join(F.transform("results", lambda x: x["run_id"].cast("string")), ",").alias("runs"))


def _timeouts(s, d):
    m = s.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("q")).agg((1.5 * F.max("o_totalprice")).alias("limit"))
    return running(m, "q", mins={"timeout": "limit"}).select("q", "timeout")


def _buffers(s, d):
    page = lambda t, k, c: s.read.parquet(f"{d}/{t}.parquet").select(F.lit(t).alias("rel"), F.expr(f"{k} div {c}").alias("page"))
    return buffer_state(page("orders", "o_orderkey", 100).union(page("customer", "c_custkey", 50)).union(page("lineitem", "l_orderkey", 25)), "rel", "page")


T.frame("exp_results", _results, "SELECT c_custkey AS query_id, c_name AS query, CAST(count(*) AS INT) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderpriority, o_orderkey) AS runs FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
T.frame("exp_adaptive_timeout", _timeouts, "WITH m AS (SELECT o_custkey AS q, max(o_totalprice) AS worst FROM orders GROUP BY 1) SELECT q, min(1.5 * worst) OVER (ORDER BY q ROWS UNBOUNDED PRECEDING) AS timeout FROM m")
T.frame("buffer_state", _buffers, "SELECT 'orders' AS rel, count(DISTINCT o_orderkey // 100) AS pages FROM orders UNION ALL SELECT 'customer', count(DISTINCT c_custkey // 50) FROM customer UNION ALL SELECT 'lineitem', count(DISTINCT l_orderkey // 25) FROM lineitem")
T.frame("pair_gen", lambda s, d: pairs_by_order(s.read.parquet(f"{d}/supplier.parquet"), "s_nationkey", "s_suppkey", "s_acctbal").select(F.col("s_nationkey").alias("q"), "pairs", "first_better"), "SELECT a.s_nationkey AS q, count(*) AS pairs, CAST(count(*) FILTER (a.s_acctbal < b.s_acctbal) AS DOUBLE) AS first_better FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY 1")
T.both("wl_split_random", "SELECT CASE WHEN U['s:' || c_custkey] < 0.2 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM customer GROUP BY 1")
T.both("wl_split_leave_one", "SELECT p_brand, min_by(p_partkey, md5('s:' || p_partkey)) AS test_id, count(*) - 1 AS train_n FROM part GROUP BY 1")
QUERIES, ORACLES = T.queries, T.oracles
