"""Running sums, least values and ranks over a whole table, without bringing it into one task.

Rows are dealt to buckets by bounds of the ordering column (approximate quantiles, so the buckets are even); windows run
inside a bucket, and what the buckets before hold is added from a table of one row a bucket. A value that very many rows
share is one bucket's: group by the value first where that can be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def _bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    as_number = F.unix_micros(F.col(by).cast("timestamp")) if dict(df.dtypes)[by].startswith("timestamp") else F.col(by).cast("double")
    rows = df.withColumn("__x", as_number.cast("double"))
    bounds = sorted(set(rows.approxQuantile("__x", [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    return rows.withColumn("__bucket", sum((F.when(F.col("__x") > float(b), 1).otherwise(0) for b in bounds), F.lit(0)))


def running(df: DataFrame, by: str, sums: dict[str, str] | None = None, mins: dict[str, str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """df with, for each new name, the sum (or least value) of a column over all rows up to this one in order of `by`.

    `by` must tell rows apart. Nulls in `by` come first.
    """
    rows = _bucketed(df, by, buckets)
    sums, mins = sums or {}, mins or {}
    each = rows.groupBy("__bucket").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()], *[F.min(c).alias(f"__m_{n}") for n, c in mins.items()])
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    base = each.select("__bucket", *[F.sum(f"__s_{n}").over(before).alias(f"__s_{n}") for n in sums], *[F.min(f"__m_{n}").over(before).alias(f"__m_{n}") for n in mins])
    inside = Window.partitionBy("__bucket").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(F.broadcast(base), "__bucket")
    for n, c in sums.items():
        found = found.withColumn(n, F.sum(c).over(inside) + F.coalesce(F.col(f"__s_{n}"), F.lit(0)))
    for n, c in mins.items():
        found = found.withColumn(n, F.least(F.min(c).over(inside), F.col(f"__m_{n}")))
    return found.select(*df.columns, *sums, *mins)


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """value, rank: the mean rank (from 1) of each distinct value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, "value", {"upto": "n"}).select("value", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def shares(df: DataFrame, col: str) -> DataFrame:
    """value, n, share: the part of all rows at or below each distinct value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return running(counts, "value", {"upto": "n"}).join(F.broadcast(total), F.lit(True)).select("value", "n", (F.col("upto") / F.col("total")).alias("share"))
