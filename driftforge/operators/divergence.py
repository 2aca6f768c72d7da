"""Divergences, correlations, tests and error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftforge.functions.twin import Twins


def js_distance(p: DataFrame, q: DataFrame, on: str) -> DataFrame:
    """Jensen-Shannon distance (square root, natural logarithm) of two distributions with columns (on, p)."""
    both = p.select(on, F.col("p").alias("a")).join(q.select(on, F.col("p").alias("b")), on, "full").na.fill(0.0, ["a", "b"])
    m = (F.col("a") + F.col("b")) / 2
    part = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return both.agg(F.sqrt(F.greatest(F.sum(part(F.col("a")) + part(F.col("b"))) / 2, F.lit(0.0))).alias("js"))


T = Twins()


def _js(s, d):
    from driftforge.operators.distributions import categorical

    o = s.read.parquet(f"{d}/orders.parquet")
    return js_distance(categorical(o.where("o_orderdate < timestamp_ntz'1998-01-01'"), "o_orderpriority"), categorical(o.where("o_totalprice > 200000"), "o_orderpriority"), "value").select(F.round("js", 8).alias("js"))


T.frame("js_distance", _js, "WITH a AS (SELECT o_orderpriority AS v, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE o_orderdate < timestamp '1998-01-01' GROUP BY 1), b AS (SELECT o_orderpriority AS v, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE o_totalprice > 200000 GROUP BY 1), j AS (SELECT coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM a FULL JOIN b ON a.v = b.v) SELECT round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 8) AS js FROM j")
_AB = "a AS (SELECT p_brand AS v, count(*) / (SELECT count(*) FROM part WHERE p_size <= 25) AS p FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT p_brand AS v, count(*) / (SELECT count(*) FROM part WHERE p_size > 25) AS p FROM part WHERE p_size > 25 GROUP BY 1)"
T.both("mean_js", f"WITH {_AB}, j AS (SELECT 1 AS k, coalesce(a.p, 0e0) AS p, coalesce(b.p, 0e0) AS q FROM a FULL JOIN b ON a.v = b.v), one AS (SELECT sqrt(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2) AS js FROM j) SELECT round(avg(js), 8) AS js FROM (SELECT js FROM one UNION ALL SELECT 0e0) x")
T.both("null_rate", "SELECT avg(CASE WHEN text IS NULL THEN 1e0 ELSE 0e0 END) AS text_null, avg(CASE WHEN lang IS NULL THEN 1e0 ELSE 0e0 END) AS lang_null FROM documents")
T.both("qerror", "WITH t AS (SELECT o_orderpriority AS k, count(*) AS actual FROM orders GROUP BY 1), e AS (SELECT o_orderpriority AS k, count(*) * 4 AS est FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) SELECT t.k, round(greatest(greatest(actual, 1) / greatest(coalesce(est, 0), 1), greatest(coalesce(est, 0), 1) / greatest(actual, 1)), 8) AS q FROM t LEFT JOIN e ON t.k = e.k")
T.both("card_fraction_qerror", "WITH c AS (SELECT count(*) AS n, sum(CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN l_quantity < 10 AND l_discount > 0.05 THEN 1 ELSE 0 END) AS ab FROM lineitem) SELECT round(greatest(greatest(ab, 1) / greatest(a / n * b, 1e0), greatest(a / n * b, 1e0) / greatest(ab, 1)), 8) AS q FROM c")
T.both("classifier_scores", "WITH r AS (SELECT o_totalprice > 150000 AS pred, o_orderstatus = 'O' AS act FROM orders), c AS (SELECT sum(CASE WHEN pred AND act THEN 1e0 ELSE 0e0 END) AS tp, sum(CASE WHEN pred AND NOT act THEN 1e0 ELSE 0e0 END) AS fp, sum(CASE WHEN NOT pred AND act THEN 1e0 ELSE 0e0 END) AS fn FROM r) SELECT round(tp / (tp + fp), 8) AS prec, round(tp / (tp + fn), 8) AS rec, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c")
T.both("regression_scores", "WITH r AS (SELECT l_extendedprice AS y, l_quantity * 1500e0 AS f FROM lineitem), m AS (SELECT avg(y) AS mu FROM r) SELECT round(avg((y - f) * (y - f)), 2) AS mse, round(1 - sum((y - f) * (y - f)) / sum((y - mu) * (y - mu)), 6) AS r2 FROM r CROSS JOIN m")
QUERIES, ORACLES = T.queries, T.oracles
