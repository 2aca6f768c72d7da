"""Shared plumbing of the corpus operators: inputs, shared folder, lineage cuts, word rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators: larger than any other id, so it is never "the smaller document".
NO_ID = 2**63 - 1

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or, where that is not set, the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return where.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; the user's own come back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later work neither recomputes nor loses it with an executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with settings(spark, {CLEANUP: "true"}):  # what the written plan shuffled is not read again
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that nothing reads again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null: empty) plus the row key (did, rk).

    rk tells apart rows that repeat a doc_id with another text; identical rows share a key and so a result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    did = F.col("doc_id").cast("long")
    return docs.select(did.alias("doc_id"), text.alias("text"), F.coalesce(did, F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("rk"), *extra)


def whole_rows(docs: DataFrame) -> DataFrame:
    """did, rk and the row itself as a struct `__row`: the columns of docs may have any names."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("rk"), row.alias("__row"))


def filtered(docs: DataFrame, chooser: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of docs that the function chosen in each task keeps. Rows stream past whole; nothing is shuffled."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # mapInArrow would resolve dots in names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = chooser()
        for b in it:
            yield b.filter(pa.array(keep(pa.RecordBatch.from_arrays(b.columns, names=names)), pa.bool_()))

    small_batches(docs.sparkSession)
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def blobs(batch: pa.RecordBatch, name: str) -> list:
    """A text column as bytes objects, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


class WordHash(dict):
    """bytes -> 64-bit hash; forgets all past a bound so that memory stays flat."""

    bound = 1_000_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.bound:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value


def pow2(n: float, least: int = 1) -> int:
    p = least
    while p < n:
        p *= 2
    return p


def number_within(df: DataFrame, group: str, by: str, out: str, salts: int) -> DataFrame:
    """Gapless numbers from 0 within each group, without bringing a group into one task.

    Rows are numbered within (group, salt); the counts of the salts before are added. The table of counts has
    salts rows for each group. `by` must not repeat within a group in ways that matter: ties are cut arbitrarily.
    """
    from pyspark.sql import Window

    salted = df.withColumn("__salt", F.pmod(F.xxhash64(F.col(by)), F.lit(salts)).cast("int"))
    counts = salted.groupBy(group, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy(group, "__salt").orderBy(by)) - 1
    return salted.withColumn("__rank", rank).join(base, [group, "__salt"]).withColumn(out, (F.col("__rank") + F.col("__base")).cast("long")).drop("__salt", "__rank", "__base")


def arrow_rows(columns: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if len(next(iter(columns.values()))):
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
