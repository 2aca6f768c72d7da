"""Analytics over plan trees: shapes and operators of many plans, subtrees, and costs by true cardinalities."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftforge.functions.twin import Twins, spark_text
from driftforge.plans.joinorder import TPCH_KEYS, Tree, build, hint, random_plan, shape, signature, subtrees, tpch_graph
from driftforge.plans.workload import suite_features

CHAIN: Tree = (((("region", "nation"), "customer"), "orders"), "lineitem")


def plan_rows(spark: SparkSession, plans: list[tuple[str, Tree, float]]) -> DataFrame:
    """plan, node (pre-order), is_leaf, hint, signature, shape, cost: a row for each node; cost is the whole plan's."""
    rows = [(name, i, isinstance(t, str), hint(t), signature(t), shape(whole), cost) for name, whole, cost in plans for i, t in enumerate(subtrees(whole))]
    return spark.createDataFrame(rows, "plan string, node int, is_leaf boolean, hint string, signature string, shape string, cost double")


def sampled_plans(spark: SparkSession, sf_dir: str, times: int = 1000) -> DataFrame:
    g, _ = tpch_graph(spark, sf_dir)
    made = [random_plan(g, random.Random(i)) for i in range(times)]
    return plan_rows(spark, [(f"p{i}", t, c) for i, (c, t) in enumerate(made)])


def shape_stats(nodes: DataFrame) -> DataFrame:
    """shape, plans, share, scans and joins of each plan on average, least and mean cost."""
    by = nodes.groupBy("plan", "shape", "cost").agg(F.sum(F.col("is_leaf").cast("long")).alias("scans"), F.sum((~F.col("is_leaf")).cast("long")).alias("joins"))
    of = by.groupBy("shape").agg(F.count(F.lit(1)).alias("plans"), F.avg("scans").alias("scans"), F.avg("joins").alias("joins"), F.round(F.min("cost"), 3).alias("least_cost"), F.round(F.avg("cost"), 3).alias("mean_cost"))
    total = of.agg(F.sum("plans").alias("n"))
    return of.join(F.broadcast(total), F.lit(True)).withColumn("share", F.round(F.col("plans") / F.col("n"), 9)).drop("n")


def true_cost(spark: SparkSession, tree: Tree, frames: dict[str, DataFrame]) -> DataFrame:
    """hint, rows of every node, by running it; the sum of rows is the plan's cost."""
    parts = [build(t, frames, TPCH_KEYS).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(hint(t)).alias("hint"), "cnt") for t in subtrees(tree)]
    return reduce(DataFrame.union, parts)


def _cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "orders", "lineitem")}
    return true_cost(spark, CHAIN, frames).agg(F.sum("cnt").alias("cost"), F.count(F.lit(1)).alias("nodes"))


T = Twins()
T.frame("plan_shape_stats", lambda s, d: shape_stats(sampled_plans(s, d)))
_ON = ["region", " JOIN nation ON r_regionkey = n_regionkey", " JOIN customer ON n_nationkey = c_nationkey", " JOIN orders ON c_custkey = o_custkey", " JOIN lineitem ON o_orderkey = l_orderkey"]
_FROM = ["region", "nation", "customer", "orders", "lineitem"] + ["".join(_ON[:k]) for k in range(2, 6)]
T.frame("cout_cost", _cost, "SELECT CAST(sum(c) AS BIGINT) AS cost, count(*) AS nodes FROM (" + " UNION ALL ".join(f"SELECT count(*) AS c FROM {x}" for x in _FROM) + ") n")
# a drifted workload: draw a feature by the target, then one of its queries with equal chance
# what suite_features() finds, for the oracle: each query of the suites with its tables
_NAMED = "job_chain_9 region nation customer supplier part orders lineitem; job_ext_group nation customer orders; job_min_star region nation supplier part orders lineitem; tpch_q01 lineitem; tpch_q02 supplier part lineitem; tpch_q03 customer orders lineitem; tpch_q04 orders lineitem; tpch_q05 region nation customer supplier orders lineitem; tpch_q06 lineitem; tpch_q07 nation customer supplier orders lineitem; tpch_q08 region nation customer supplier part orders lineitem; tpch_q09 nation supplier part orders lineitem; tpch_q10 nation customer orders lineitem; tpch_q11 supplier lineitem; tpch_q12 orders lineitem; tpch_q13 customer orders; tpch_q14 part lineitem; tpch_q15 supplier revenue; tpch_q16 supplier part lineitem; tpch_q17 part lineitem; tpch_q18 customer orders lineitem; tpch_q19 part lineitem; tpch_q20 supplier part lineitem; tpch_q21 supplier orders lineitem; tpch_q22 customer orders"
_PAIRS = ", ".join(f"('{q}', '{t}')" for q, *named in map(str.split, _NAMED.split(";")) for t in named)
_SAMPLE = """WITH w AS ({workload}),
c AS (SELECT feature, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, feature) AS k FROM w GROUP BY feature),
z AS (SELECT feature, cnt, (1e0 / k) / (SELECT sum(1e0 / k) FROM c) AS q, k FROM c),
b AS (SELECT feature, cnt, k, coalesce(sum(q) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, CASE WHEN k = (SELECT max(k) FROM z) THEN 1e0 ELSE sum(q) OVER (ORDER BY k) END AS hi FROM z),
d AS (SELECT i, feature, CAST(floor(U['wr:' || i] * cnt) AS BIGINT) + 1 AS n FROM ({draws}) r JOIN b ON U['wq:' || i] >= lo AND U['wq:' || i] < hi),
o AS (SELECT id, feature, row_number() OVER (PARTITION BY feature ORDER BY id) AS n FROM w)
SELECT o.id, o.feature, count(*) AS drawn FROM d JOIN o ON d.feature = o.feature AND d.n = o.n GROUP BY o.id, o.feature"""


def drifted_sample(spark: SparkSession, features: DataFrame) -> DataFrame:
    """id, feature, drawn: 500 draws from a workload given as id, feature."""
    features.select("id", "feature").createOrReplaceTempView("wl_features")
    return spark.sql(spark_text(_SAMPLE.format(workload="SELECT id, feature FROM wl_features", draws="SELECT explode(sequence(0, 499)) AS i")))


T.frame("wl_drift_sample", lambda s, d: drifted_sample(s, suite_features(s, d).where("kind = 'table'")), _SAMPLE.format(workload=f"SELECT * FROM (VALUES {_PAIRS}) v(id, feature)", draws="SELECT unnest(range(0, 500)) AS i"))
T.oracles["wl_tables"] = f"SELECT feature, count(*) AS n FROM (VALUES {_PAIRS}) v(id, feature) GROUP BY feature"
QUERIES, ORACLES = T.queries, T.oracles
