"""SQL that two engines answer alike: one text, with the few dialect differences as marks.

U[x]   a uniform number in [0, 1) from the md5 of the string x: the source of all sampling, so draws are repeatable
       on any engine and under any partitioning
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_SPARK = r"(cast(conv(substr(md5(\1), 1, 8), 16, 10) AS BIGINT) / 4294967296e0)"
_DUCK = r"(CAST(CAST('0x' || substr(md5(\1), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296e0)"
_MARK = re.compile(r"U\[([^\]]*)\]")


def spark_text(sql: str) -> str:
    return _MARK.sub(_SPARK, sql)


def duck_text(sql: str) -> str:
    return _MARK.sub(_DUCK, sql)


def run_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query as a function of (spark, folder); only the tables it names are opened."""
    text = spark_text(sql)
    named = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in named:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return query


class Twins:
    """Queries with their oracles."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def both(self, name: str, sql: str, duck: str | None = None) -> None:
        self.queries[name] = run_sql(sql)
        self.oracles[name] = duck_text(duck or sql)

    def frame(self, name: str, query: Callable[[SparkSession, str], DataFrame], duck: str | None = None) -> None:
        self.queries[name] = query
        if duck:
            self.oracles[name] = duck_text(duck)
