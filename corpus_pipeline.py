"""The corpus pipeline: quality, near copies, repeated passages, benchmark leaks, packing.

Every stage takes what the one before kept, read back from the shared folder. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftforge.llm import decontaminate, packing, quality, simhash, suffix_array
from driftforge.llm.common import cut, table

STAGES = [
    ("quality classifier", quality.stage),
    ("SimHash near-dedup", simhash.stage),
    ("suffix-array dedup", suffix_array.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: Trained models and tokenizers can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
