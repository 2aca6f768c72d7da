"""Approximate-query evaluation, completion of missing tuples, and analytics over latency logs.

The log is `events`: event_type is the method, user_id the query, value the latency, event_id the order of runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftforge.functions.running import running, shares
from driftforge.functions.twin import Twins


def aqp(df: DataFrame, agg: str, col: str | None, where: Sequence[tuple] = (), groups: Sequence[str] = (), weight: str | None = None, upscale: float = 1.0) -> DataFrame:
    """groups, result: COUNT, SUM or AVG over rows that meet all (column, operator, value); rows weigh what `weight` says."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    for c, op, v in where:
        df = df.where(F.col(c).isin(list(v)) if op.upper() == "IN" else F.expr(f"`{c}` {_OPS[op]} {_literal(v)}"))
    if agg.upper() == "COUNT":
        result = F.sum(w) * upscale
    elif agg.upper() == "SUM":
        result = F.sum(w * F.col(col)) * upscale
    else:
        result = F.sum(w * F.col(col)) / F.sum(F.when(F.col(col).isNotNull(), w))
    return df.groupBy(*groups).agg(result.alias("result"))


_OPS = {"=": "=", "!=": "<>", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def _literal(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def aqp_sql(table: str, agg: str, col: str | None, where: Sequence[tuple] = (), groups: Sequence[str] = ()) -> str:
    """The query as SQL text."""
    what = "COUNT(*)" if agg.upper() == "COUNT" else f"{agg.upper()}({col})"
    conds = " AND ".join(f"{c} IN ({', '.join(map(_literal, v))})" if op.upper() == "IN" else f"{c} {_OPS[op]} {_literal(v)}" for c, op, v in where)
    return f"SELECT {''.join(g + ', ' for g in groups)}{what} AS result FROM {table}" + (f" WHERE {conds}" if conds else "") + (f" GROUP BY {', '.join(groups)}" if groups else "")


def without_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table without its key columns, as a model that may not learn them would see it."""
    return df.drop(*[c for c in keys if c in df.columns])


LOG = "run_id int, run_type string, experiment string, method string, query_ident string, split string, inference_time double, planning_time double, execution_time double, timed_out boolean"


def union_logs(logs: Sequence[DataFrame]) -> DataFrame:
    """Logs of several methods as one; columns that one lacks are null; total_time is the sum of the three times."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("inference_time", "planning_time", "execution_time")), F.lit(0.0))
    none = logs[0].sparkSession.createDataFrame([], LOG)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs, none).withColumn("total_time", total)


def completeness(log: DataFrame, by: Sequence[str] = ("method", "experiment", "split")) -> DataFrame:
    """Rows of each group, null keys a group of their own."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _as_logs(s, d) -> list[DataFrame]:
    """Three methods' logs from `events`; the last one has no splits."""
    e = s.read.parquet(f"{d}/events.parquet")
    base = lambda kind: e.where(F.col("event_type") == kind).select(F.col("event_type").alias("method"), F.col("user_id").cast("string").alias("query_ident"), (F.col("user_id") % 4).cast("string").alias("split"), F.col("value").alias("execution_time"))
    return [base("click"), base("view"), base("purchase").drop("split")]


T = Twins()
T.frame("aqp_group", lambda s, d: aqp(s.read.parquet(f"{d}/lineitem.parquet").withColumn("w", F.when(F.col("l_linenumber") == 1, 2.0).otherwise(1.0)), "AVG", "l_extendedprice", [("l_quantity", ">", 10)], ["l_returnflag"], "w").select("l_returnflag", F.round("result", 6).alias("weighted_avg")), "SELECT l_returnflag, round(sum(l_extendedprice * w) / sum(w), 6) AS weighted_avg FROM (SELECT l_returnflag, l_extendedprice, 1 + CAST(l_linenumber = 1 AS INT) AS w FROM lineitem WHERE l_quantity > 10) x GROUP BY 1")
T.frame("aqp_to_sql", lambda s, d: (s.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("lineitem"), s.sql(aqp_sql("lineitem", "COUNT", None, [("l_returnflag", "IN", ["A", "R"]), ("l_quantity", "<=", 10.0)], ["l_linestatus"])))[1], "SELECT l_linestatus, sum(CASE WHEN l_returnflag <> 'N' AND l_quantity <= 10 THEN 1 ELSE 0 END) AS result FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_returnflag <> 'N' AND l_quantity <= 10 THEN 1 ELSE 0 END) > 0")
T.frame("pk_removal", lambda s, d: without_keys(s.read.parquet(f"{d}/customer.parquet"), ["c_custkey", "c_nationkey"]), "SELECT c_name, c_acctbal, c_mktsegment FROM customer")
T.frame("log_completeness", lambda s, d: completeness(union_logs(_as_logs(s, d)), ["method", "split"]), "SELECT event_type AS method, CASE WHEN event_type <> 'purchase' THEN CAST(user_id % 4 AS VARCHAR) END AS split, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2")
T.frame("res_cumulative", lambda s, d: running(s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,6)")).cast("decimal(28,6)").alias("v")), "user_id", {"acc": "v"}).select("user_id", F.col("acc").cast("decimal(38,6)").alias("acc")), "WITH t AS (SELECT user_id, sum(CAST(value AS DECIMAL(18, 6))) AS v FROM events GROUP BY 1) SELECT user_id, CAST(sum(v) OVER (ORDER BY user_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(38, 6)) AS acc FROM t")
T.frame("latency_curve", lambda s, d: shares(s.read.parquet(f"{d}/events.parquet").select(F.floor("value").cast("long").alias("v")), "v").select(F.col("value").alias("v"), F.round("share", 9).alias("share")), "SELECT DISTINCT CAST(floor(value) AS BIGINT) AS v, round(cume_dist() OVER (ORDER BY floor(value)), 9) AS share FROM events")
_AQP = "SELECT l_returnflag AS g, count(*) AS c, sum(l_quantity) AS s, avg(l_extendedprice) AS a FROM lineitem WHERE l_discount >= 0.02"
_ERR = f"WITH r AS ({_AQP} GROUP BY 1), f AS (SELECT g, c * 2 AS c, s * 2 AS s, a FROM ({_AQP} AND U['q:' || l_orderkey] < 0.5 GROUP BY 1) x), e AS (SELECT r.g, abs(r.c - coalesce(f.c, 0)) / (abs(r.c) + 1) AS ec, abs(r.s - coalesce(f.s, 0)) / (abs(r.s) + 1) AS es, abs(r.a - coalesce(f.a, 0)) / (abs(r.a) + 1) AS ea FROM r FULL JOIN f ON r.g = f.g)"
T.both("aqp_rel_error", _ERR + " SELECT g, round(ec, 8) AS ec, round(es, 8) AS es, round(ea, 8) AS ea FROM e")
_P = ", x AS (SELECT ec AS v FROM e UNION ALL SELECT es FROM e UNION ALL SELECT ea FROM e) SELECT round({q}(v, 0.5), 8) AS p50, round({q}(v, 0.75), 8) AS p75, round({q}(v, 0.9), 8) AS p90, round({q}(v, 0.99), 8) AS p99, round(max(v), 8) AS worst, round(avg(v), 8) AS mean FROM x"
T.both("aqp_percentiles", _ERR + _P.format(q="percentile"), _ERR + _P.format(q="quantile_cont"))
T.both("error_reduction", "WITH a AS (SELECT avg(o_totalprice) AS r FROM orders), i AS (SELECT avg(o_totalprice) AS i FROM orders WHERE o_orderkey % 3 = 0), c AS (SELECT avg(o_totalprice) AS c FROM orders WHERE o_orderkey % 3 <> 1) SELECT round((i - c) / i, 8) AS err_red, round(1 - abs(c - r) / abs(r - i), 6) AS bias_red FROM a CROSS JOIN i CROSS JOIN c")
T.both("tf_expand", "WITH c AS (SELECT c_custkey, coalesce(n, 0) AS seen FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey), m AS (SELECT c_custkey, explode(sequence(1, CAST(12 - seen AS INT))) AS copy FROM c WHERE seen < 12) SELECT c_custkey, copy FROM m", "WITH c AS (SELECT c_custkey, coalesce(n, 0) AS seen FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey), m AS (SELECT c_custkey, unnest(range(1, 13 - seen)) AS copy FROM c WHERE seen < 12) SELECT c_custkey, CAST(copy AS INT) AS copy FROM m")
T.both("completion_missing", "SELECT CASE WHEN o_orderkey IS NULL AND n_nationkey IS NULL THEN 'both' WHEN o_orderkey IS NULL THEN 'orders' WHEN n_nationkey IS NULL THEN 'nation' ELSE 'none' END AS missing, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) n ON c_nationkey = n_nationkey GROUP BY 1")
T.both("completion_union", "SELECT src, count(*) AS n, round(avg(o_totalprice), 4) AS a FROM (SELECT 'real' AS src, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'synthetic', o_totalprice * 1.01e0 FROM orders WHERE o_orderkey % 2 = 1) x GROUP BY src")
T.both("conditional_reject", "WITH f AS (SELECT o_orderstatus AS st, o_orderpriority AS pr, count(*) AS n FROM orders GROUP BY 1, 2), d AS (SELECT DISTINCT o_orderpriority AS pr FROM orders WHERE o_orderkey % 2 = 0) SELECT st, f.pr, round(n / sum(n) OVER (PARTITION BY st), 9) AS p FROM f JOIN d ON f.pr = d.pr")
T.both("res_agg", "SELECT event_type, user_id % 10 AS split, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, max(value) AS worst, count(*) AS n FROM events GROUP BY 1, 2")
T.both("res_ci", "SELECT event_type, round(avg(value), 6) AS mean, round(1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS ci FROM events GROUP BY 1")
T.both("res_signif", "WITH m AS (SELECT event_type, user_id % 20 AS q, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM events GROUP BY 1, 2) SELECT a.q, a.event_type AS a_type, b.event_type AS b_type, round(a.m - b.m, 6) AS diff FROM m a JOIN m b ON a.q = b.q AND a.event_type < b.event_type WHERE abs(a.m - b.m) > 0.2 * sqrt(a.s * a.s + b.s * b.s)")
T.both("res_ratio_moments", "WITH t AS (SELECT avg(o_totalprice) AS ex, avg(1 / (o_totalprice + 1)) AS ey, avg(o_totalprice * o_totalprice) AS ex2, avg(1 / ((o_totalprice + 1) * (o_totalprice + 1))) AS ey2 FROM orders) SELECT round(ex * ey, 6) AS e, round((ex2 * ey2 - ex * ex * ey * ey) / (ex2 * ey2), 6) AS v FROM t")
T.both("res_top_diff", "WITH d AS (SELECT user_id, avg(value) - (SELECT avg(value) FROM events) AS diff FROM events GROUP BY 1) SELECT user_id, round(diff, 6) AS diff FROM d ORDER BY round(abs(diff), 6) DESC, user_id LIMIT 10")
T.both("res_stability", "WITH f AS (SELECT event_type, 1.96 * stddev_pop(value) / sqrt(count(*)) / min_by(value, event_id) AS ci, (max(value) - min(value)) / median(value) AS spread FROM events GROUP BY 1) SELECT event_type, round(ci, 6) AS ci, round(spread, 6) AS spread FROM f WHERE ci < spread")
T.both("gmrl", "WITH b AS (SELECT user_id, min(value) AS base, max(value) AS last FROM events WHERE value > 0 GROUP BY 1) SELECT round(exp(avg(ln(last / base))), 6) AS gmrl FROM b")
T.both("running_stats", "SELECT event_type, round(avg(value), 6) AS m, round(var_samp(value), 5) AS v FROM events GROUP BY 1")
T.both("best_worst_last", "SELECT user_id, max_by(value, event_id) AS last_value, min(value) AS best, max(value) AS worst FROM events GROUP BY 1")
T.both("timeout_override", "SELECT event_type, round(avg(CASE WHEN value > 90 THEN 360000e0 ELSE value END), 6) AS m, sum(CASE WHEN value > 90 THEN 1e0 ELSE 0e0 END) AS timeouts FROM events GROUP BY 1")
T.both("third_run", "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS it FROM events) x WHERE it = 3")
T.both("workload_sums", "SELECT event_type, CAST(sum(m) AS DECIMAL(28, 6)) AS total, count(*) AS queries FROM (SELECT event_type, user_id, CAST(avg(value) AS DECIMAL(18, 6)) AS m FROM events GROUP BY 1, 2) x GROUP BY 1")
T.both("epoch_filter", "SELECT CAST(extract(day FROM ts) AS INT) AS epoch, count(*) AS n FROM events GROUP BY 1 HAVING CAST(extract(day FROM ts) AS INT) <= 50")
T.both("hinter_ratio", "WITH b AS (SELECT user_id, min_by(value, event_id) AS base, sum(value) AS total FROM events GROUP BY 1) SELECT user_id, round(base / total, 8) AS ratio FROM b WHERE total > 0")
QUERIES, ORACLES = T.queries, T.oracles
