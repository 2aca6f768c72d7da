"""Operator 5: host-level quality rules with an empirical beta prior.

Every document is counted once; rule failures are pre-aggregated by host (`source`), each host's failure rate is shrunk
towards the rate of all hosts, as strongly as the spread between hosts says, and the host's verdict is joined back. The
join carries no hint: the host table is broadcast only if its measured size allows, and a hot host can be split.

Rules of a document, besides the base ones: more than one symbol for each four words; more than half its lines repeat
earlier ones. A host is rejected if its shrunk rate of documents that fail any rule exceeds MAX_RATE: a half, beyond
which the host's next document rather fails than passes, so that what passes there passes by luck.

Edge cases: null text has no words, so fails; null source is a host of its own; with one host, or none that differ, the
prior has DEFAULT_STRENGTH; a very long text is counted whole; an empty table gives no rows; repeated rows count each;
other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftforge.llm.common import arrow_rows, blobs, cut, small_batches, table

MAX_RATE = 0.5
DEFAULT_STRENGTH = 100.0
MOST_STRENGTH = 10_000.0
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))


def base_counts(x: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    words = x.split()
    n = len(words)
    lines = [y for y in x.split(b"\n") if y.strip()]
    repeat = 0
    if n > 3:
        number: dict[bytes, int] = {}
        t = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        v = len(number)
        if v < 2_000_000:
            keys = (t[:-2] * v + t[1:-1]) * v + t[2:]
        else:
            keys = np.unique(t[:-2] * v + t[1:-1], return_inverse=True)[1] * v + t[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        mark = np.zeros(n, bool)
        at = order[twice]
        for k in range(3):
            mark[at + k] = True
        repeat = int(np.count_nonzero(mark))
    return n, len(b"".join(words).translate(None, _CONTINUED)), len(x) - len(x.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines)


def counted(docs: DataFrame) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string())] + [(n, pa.int64()) for n in names])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = list(zip(*map(base_counts, blobs(b, "text")), strict=True)) or [[]] * len(names)
            yield from arrow_rows({"doc_id": b.column(0), "host": b.column(1)} | dict(zip(names, rows, strict=True)), schema)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{n} long" for n in names))


def host_verdicts(failures: DataFrame) -> DataFrame:
    """failures: host, failed. host, n, failures, rate (shrunk), host_ok."""
    by = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    prior = by.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    m, v = F.col("m"), F.col("v")
    strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / F.when(v > 0, v) - 1, F.lit(1.0)), F.lit(MOST_STRENGTH))).otherwise(DEFAULT_STRENGTH)
    prior = prior.select("m", strength.alias("strength"))
    shrunk = (F.col("failures") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    # the prior is one row
    return by.join(F.broadcast(prior), F.lit(True)).select("host", "n", "failures", shrunk.alias("rate"), (shrunk <= MAX_RATE).alias("host_ok"))


def host_rules(docs: DataFrame) -> DataFrame:
    rows = counted(docs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    more = (4 * F.col("n_symbols") > F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("n_lines"))
    rows = cut(rows.withColumn("base_failed", base).withColumn("failed", base | more), "counts")
    verdicts = host_verdicts(rows.select("host", "failed"))
    joined = rows.join(verdicts.withColumnRenamed("host", "of_host"), F.col("host").eqNullSafe(F.col("of_host")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_ok")).alias("kept"), F.round("rate", 6).alias("host_rate"),
    )


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
gram AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM win),
twice AS (SELECT doc_id, k FROM gram GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM gram SEMI JOIN twice USING (doc_id, k)) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(line.n - line.u, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(line.n, 0) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN line USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
g AS (SELECT *, base_failed OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines AS failed FROM f),
h AS (SELECT host, count(*) AS n, sum(CAST(failed AS INT)) AS k FROM g GROUP BY host),
p AS (SELECT avg(k / n) AS m, coalesce(var_pop(k / n), 0) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 10000.0) ELSE 100.0 END AS s FROM p),
r AS (SELECT host, (k + m * s) / (n + s) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept, round(rate, 6) AS host_rate
FROM g LEFT JOIN r ON g.host IS NOT DISTINCT FROM r.host
"""

QUERIES = {"op5_host_rules": op5_host_rules}
ORACLES = {"op5_host_rules": OP5_SQL}
