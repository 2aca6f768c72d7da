"""Connected components of a link table, by alternating large and small stars. Nothing goes to the driver but sums.

A star's least node is found by partial sums. The links of a star's centre meet its least node in a join, whose one hot
side Spark splits at run time (spark.sql.adaptive.skewJoin) once it is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftforge.llm.common import cut, drop


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    onto = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onto.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (u long, v long) -> (u, root) for every node with a link whose component's least node is not itself.

    Each round halves the distance to the least node, so rounds grow with the logarithm of the longest path.
    """
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        said = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == said or not said.n:
            return now.select("u", F.col("v").alias("root"))
        before = said
        last, now = now, cut(_small(_large(now)).distinct(), "links")
        drop(last)
    raise RuntimeError(f"components: not settled after {rounds} rounds")
