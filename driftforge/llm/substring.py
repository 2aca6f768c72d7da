"""Operator 4: word-level removal of repeated passages, by matching statistics against suffix automata.

Reference shards are automata of text that smaller documents hold; documents are streamed past them, and where the
matching statistic reaches the threshold the span is removed. One broadcast automaton of the whole corpus would grow
with the corpus, so a shard's automaton goes where its text can match: anchors (see anchors.py) bring every snippet
that can share a window with a reference snippet to the task that holds that shard, in ascending doc_id order.

Edge cases: null text has no words; documents of fewer than 13 words keep everything; passages that repeat only
inside a document, or only in rows of the same doc_id, stay; null doc_id counts as the largest id and stays null;
identical rows get identical results; very long texts are hashed in pieces that overlap by a window; an empty table
gives an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftforge.llm.anchors import Plan, covered, repeated_windows, span_lists
from driftforge.llm.automaton import SuffixAutomaton
from driftforge.llm.common import WordHash, arrow_rows, blobs, keyed, table

WIDTH = 13
#: Bytes of distinct snippets that one automaton holds.
SHARD = 600_000

_hashes = WordHash()


def _tokens(x: bytes) -> np.ndarray:
    """bytes.split() splits at [\\x20\\x09-\\x0D] and nowhere else."""
    words = x.split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _cutter(x: bytes):
    words = x.split()
    return lambda lo, hi: b" ".join(words[lo:hi])


PLAN = Plan(_tokens, _cutter, WIDTH, 6)


def repeated(snippets: list[bytes], documents: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each snippet, the starts of its windows that also start in a snippet of a smaller document."""
    shard = SuffixAutomaton()
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(snippets)
    order = sorted(range(len(snippets)), key=documents.__getitem__)
    pending: list[list[bytes]] = []
    for at, i in enumerate(order):
        if at and documents[i] != documents[order[at - 1]]:
            for words in pending:
                shard.add(words)
            pending = []
        words = snippets[i].split()
        hits = [e - width + 1 for e, n in enumerate(shard.matching(words)) if n >= width]
        if hits:
            out[i] = np.array(hits, np.int64)
        pending.append(words)
    return out


def removals(docs: DataFrame) -> DataFrame:
    """(did, rk, spans): see anchors.repeated_windows."""
    return repeated_windows(docs, PLAN, repeated, SHARD)


def _cut(it: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out: dict[str, list] = {f.name: [] for f in schema}
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        for d, x, r in zip(ids, blobs(batch, "text"), span_lists(batch), strict=True):
            words = x.split()
            kept = list(compress(words, ~covered(r, len(words), WIDTH))) if r is not None else words
            body = b" ".join(kept)
            for name, v in (("doc_id", d), ("n_words", len(words)), ("n_removed", len(words) - len(kept)), ("kept_sha256", hashlib.sha256(body).hexdigest()), ("kept", body)):
                if name in out:
                    out[name].append(v)
        yield from arrow_rows(out, schema)


def passage_removal(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and, with texts, kept (the words left, joined by one space)."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * texts
    schema = pa.schema(fields)
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return keyed(docs).join(removals(docs), ["did", "rk"], "left").mapInArrow(lambda it: _cut(it, schema), ddl)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_removal(table(spark, sf_dir, "documents"), texts=False)


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p),
first AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN first USING (k) WHERE doc_id > m),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES = {"op4_substring_dedup": OP4_SQL}
