"""Files in and out: delimited tables, SQL workloads, key sets."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header: bool = False) -> DataFrame:
    """CSV or, with sep '|', TBL; the schema is given, never inferred. A trailing separator's empty column is dropped."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*want.fields, StructField("__end", StringType())]) if sep == "|" else want
    df = spark.read.schema(full).option("sep", sep).option("escape", "\\").option("header", header).csv(path)
    return df.select(*want.names)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = False) -> None:
    df.write.option("sep", sep).option("escape", "\\").option("header", header).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def with_header(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    """Delimited files without a header, written again with one; values stay text."""
    write_delimited(read_delimited(spark, source, StructType([StructField(n, StringType()) for n in names])), target, header=True)


def write_query_files(queries: DataFrame, path: str) -> None:
    """A folder `id=...` for each query (id, sql), written in parallel."""
    queries.select("id", F.col("sql").alias("value")).repartition("id").write.mode("overwrite").partitionBy("id").text(path)


def write_features(features: DataFrame, path: str) -> None:
    """The table of queries and features (id, kind, feature) as CSV with a header."""
    write_delimited(features.select("id", "kind", "feature"), path, header=True)


def tbl_to_csv(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """Pipes to commas with a header; commas inside texts become semicolons."""
    df = read_delimited(spark, source, schema, "|")
    texts = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    write_delimited(df.select(*[F.translate(c, ",", ";").alias(c) if c in texts else F.col(c) for c in df.columns]), target, ",", True)


def read_sql_folder(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, sql: every statement of every file, comments dropped, white space squashed; literals keep their case."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"--[^\n]*", "").alias("value"))
    # a semicolon ends a statement where an even number of quotes stands before it: not inside a literal
    rows = text.select("file", F.posexplode(F.split("value", r";(?=(?:[^']*'[^']*')*[^']*$)")).alias("place", "sql"))
    rows = rows.select("file", "place", F.trim(F.regexp_replace("sql", r"\s+", " ")).alias("sql")).where("sql <> ''")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("file").orderBy("place")) - 1).select("file", "ordinal", "sql")


def read_merged_workload(spark: SparkSession, path: str) -> DataFrame:
    """id, sql from lines `id#####sql;`."""
    parts = F.split("value", "#####", 2)
    return spark.read.text(path).where("value like '%#####%'").select(parts[0].alias("id"), F.rtrim(F.regexp_replace(parts[1], ";$", "")).alias("sql"))


def write_merged_workload(queries: DataFrame, path: str) -> None:
    queries.select(F.concat(F.col("id").cast("string"), F.lit("#####"), F.col("sql"), F.lit(";")).alias("value")).write.mode("overwrite").text(path)


def workload_json(queries: DataFrame, time: float = -1.0) -> DataFrame:
    """One JSON row a query: [sql, id, [time, false]]."""
    text = lambda c: F.to_json(F.array(F.col(c).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(c).cast("string")))) - 2)
    return queries.select(F.concat(F.lit("["), text("sql"), F.lit(", "), text("id"), F.lit(f", [{time}, false]]")).alias("value"))


def key_bits(name: str) -> int:
    """32 or 64, as the file's name says; any other name is an error."""
    for bits in (32, 64):
        if f"uint{bits}" in name.rpartition("/")[2]:
            return bits
    raise ValueError(f"{name} names no key type (uint32 or uint64)")


#: Bytes of a key file that one task reads at a time.
RANGE = 32 << 20


def read_keys(spark: SparkSession, path: str, bits: int | None = None) -> DataFrame:
    """Key sets: an 8-byte count, then little-endian unsigned keys, the type from the file's name unless it is given.

    file, key (decimal(20,0): 64-bit keys have no Java type). Files are listed with their sizes and read in byte ranges,
    so a file is many tasks' work; a missing file, a name without a type, or a count that is not the file's is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # names and sizes only
    if not files:
        raise FileNotFoundError(path)
    ranges = []
    for f in files:
        b = bits or key_bits(f.path)
        ranges += [(f.path, b, at, min(RANGE, f.length - at), f.length) for at in range(8, max(9, f.length), RANGE)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, b, at, n, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                system, where = pafs.FileSystem.from_uri(file if "://" in file else file.replace(":/", ":///", 1))
                with system.open_input_file(where) as f:
                    (count,) = struct.unpack("<Q", f.read_at(8, 0))
                    if count * b // 8 != length - 8:
                        raise ValueError(f"{file}: header says {count} keys, found {(length - 8) * 8 / b}")
                    keys = np.frombuffer(f.read_at(max(0, n), at), f"<u{b // 8}")
                for k in range(0, len(keys), 100_000):
                    part = pa.array(keys[k : k + 100_000].astype(np.uint64)).cast(pa.decimal128(20, 0))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), part], names=["file", "key"])

    rows = spark.createDataFrame(ranges, "file string, bits int, start long, size long, length long")
    return rows.repartition(len(ranges)).mapInArrow(run, "file string, key decimal(20,0)")


def write_keys(keys: DataFrame, path: str, bits: int | None = None) -> int:
    """One sorted key file, in pieces that executors pack: the driver only joins bytes, a piece at a time, in order."""
    bits = bits or key_bits(path)
    kind = f"<u{bits // 8}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw = np.array([int(k) for k in b.column(0).to_pylist()], kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["raw"])

    key = F.col(keys.columns[0]).cast("decimal(20,0)").alias("key")
    packed = keys.select(key).where("key is not null").orderBy("key").mapInArrow(run, "raw binary")
    n = 0
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", 0))
        for row in packed.toLocalIterator():
            f.write(row.raw)
            n += len(row.raw) * 8 // bits
        f.seek(0)
        f.write(struct.pack("<Q", n))
    return n


def first_column_keys(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """key: the whole numbers of a delimited file's first column, its header skipped; other values are left out."""
    first = F.split("value", f"[{sep}]", 2)[0]
    return spark.read.text(path).select(F.trim(F.regexp_replace(first, '"', "")).alias("x")).selectExpr("try_cast(x as bigint) as key").where("key is not null")


def coerce(df: DataFrame, head: int = 5) -> DataFrame:
    """Floating columns whose first rows are whole and not null become whole numbers, nulls 0; others stay.

    The rule looks at the first `head` rows, as loaders of such tables do; a table that must keep fractions further down
    should be read with a schema.
    """
    rows = df.limit(head).collect()
    out = {}
    for f in df.schema.fields:
        if f.dataType.typeName() in ("float", "double") and rows:
            seen = [r[f.name] for r in rows]
            if all(v is not None and v == v and abs(v - int(v)) < 1e-5 for v in seen):
                out[f.name] = F.coalesce(F.nanvl(F.col(f.name), F.lit(None).cast("double")), F.lit(0.0)).cast("bigint")
    return df.withColumns(out) if out else df


def write_document(value, path: str) -> None:
    """One indented JSON document of driver values; numpy numbers and arrays as plain ones."""
    plain = lambda x: x.tolist() if hasattr(x, "tolist") else str(x)
    with open(path, "w") as f:
        json.dump(value, f, indent=4, default=plain)


def write_text(text: str, path: str) -> None:
    with open(path, "w") as f:
        f.write(text)


def write_numbered_queries(queries: list[str], folder: str) -> None:
    """A file {i}.sql for each query of a driver's list; tables of queries go through write_query_files."""
    os.makedirs(folder, exist_ok=True)
    for i, q in enumerate(queries):
        write_text(q, f"{folder}/{i}.sql")


RUN_TYPES = ("no_geqo", "no_bitmap_tidscan")


def read_run_log(spark: SparkSession, path: str, keep: int | None = 2, method: str | None = None) -> DataFrame:
    """Logs of lines `hint, iteration, time, query path, planning, execution, method` in the shape of evaluation.LOG.

    The run type is what the file's name says, else regular; of repeated runs number `keep` (from 0) counts.
    """
    from driftforge.operators.encoders import query_ident

    part = F.split("value", ", ")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    kind = F.coalesce(*[F.when(F.contains(name, F.lit(k)), F.lit(k)) for k in RUN_TYPES], F.when(F.contains(name, F.lit("imdb2_tested")), "imdb50"), F.lit("regular"))
    rows = spark.read.text(path).where(F.size(part) >= 7)
    rows = rows.select(
        F.lit(0).alias("run_id"), kind.alias("run_type"), F.lit(None).cast("string").alias("experiment"), (F.lit(method) if method else part[6]).alias("method"), query_ident(part[3]).alias("query_ident"),
        F.lit(None).cast("string").alias("split"), F.lit(0.0).alias("inference_time"), part[4].cast("double").alias("planning_time"), part[5].cast("double").alias("execution_time"), F.lit(False).alias("timed_out"), part[1].cast("int").alias("__it"),
    )
    return (rows.where(F.col("__it") == keep) if keep is not None else rows).drop("__it")


def read_plan_log(spark: SparkSession, path: str) -> DataFrame:
    """Logs of lines `id#####json`: id, plan (the JSON), execution_time (its field Execution Time)."""
    part = F.split("value", "#####", 2)
    doc = F.when(F.get_json_object(part[1], "$[0]").isNotNull(), F.get_json_object(part[1], "$[0]")).otherwise(part[1])
    return spark.read.text(path).where("value like '%#####%'").select(part[0].alias("id"), part[1].alias("plan"), F.get_json_object(doc, "$['Execution Time']").cast("double").alias("execution_time"))


def read_pattern_log(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Text logs by a regular expression with a group for each name; other lines are left out."""
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def fill_templates(template: str, parameters: DataFrame) -> DataFrame:
    """id, sql: a query template with :name marks, filled from the columns of each row of parameters (id and the names)."""
    out = F.lit(template)
    for c in sorted((c for c in parameters.columns if c != "id"), key=len, reverse=True):
        out = F.replace(out, F.lit(f":{c}"), F.col(c).cast("string"))
    return parameters.select(F.col("id").cast("string").alias("id"), out.alias("sql"))
