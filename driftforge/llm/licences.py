"""Operator 10: licence scans by matching statistics against a generalised suffix automaton of licence tokens.

Templates are short notices; the automaton holds all of them and the base phrases. Files are streamed: runs of words
that some template holds go through the automaton, any other word resets it. Matches of MIN_MATCH words or more are
chained along each template, in order and with at most MAX_GAP words between them; a template covered by MIN_COVER or
more adds its label. A base phrase found whole is a template covered wholly.

Edge cases: null text has no words, no labels, score 0; repeated rows are scanned each; null doc_id stays null; very long
texts are scanned run by run; other columns are left alone, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftforge.llm.automaton import SuffixAutomaton
from driftforge.llm.common import arrow_rows, blobs, small_batches, table

MIN_MATCH = 4
MAX_GAP = 8
MIN_COVER = 0.6
#: Fixed values of the task.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Wording of public licence notices.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "proprietary": "all rights reserved unauthorized copying of this file via any medium is strictly prohibited",
}
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def licence_words(x: bytes) -> list[bytes]:
    return x.translate(_FOLD).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Scanner:
    def __init__(self) -> None:
        texts = [(label, t.encode().split()) for label, t in TEMPLATES.items()]
        self.phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
        self.ids = _Vocabulary()
        for _, words in texts + [(label, p) for p, label in self.phrases]:
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.templates = [(label, [self.ids[w] for w in words]) for label, words in texts]
        self.tool = SuffixAutomaton()
        for words in [t for _, t in self.templates] + [[self.ids[w] for w in p] for p, _ in self.phrases]:
            self.tool.add(words)
        n = len(self.tool.next)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (template, last place) of a state's runs
        for i, (_, words) in enumerate(self.templates):
            v = 0
            for e, w in enumerate(words):
                v = self.tool.next[v][w]
                u = v
                while u > 0:
                    self.ends[u].append((i, e))
                    u = self.tool.link[u]
        under: dict[int, list[tuple[int, int]]] = {}
        for k, (p, _) in enumerate(self.phrases):
            v = 0
            for w in p:
                v = self.tool.next[v][self.ids[w]]
            under.setdefault(v, []).append((k, len(p)))
        self.suffixes: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # phrases that a state's longest run ends with
        for v in range(n):
            u = v
            while u > 0:
                self.suffixes[v] += under.get(u, [])
                u = self.tool.link[u]

    def scan(self, x: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        words = licence_words(x)
        t = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        on = np.concatenate(([0], (t > 0).astype(np.int8), [0]))
        edge = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
        places: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        nxt, link, length, suffixes = self.tool.next, self.tool.link, self.tool.len, self.suffixes
        for a, b in edge[edge[:, 1] - edge[:, 0] > 1].tolist():
            v = n = 0
            for e, tok in enumerate([*t[a:b].tolist(), 0], a):
                to = nxt[v].get(tok)
                if to is None:
                    if n >= MIN_MATCH:  # a match that cannot go on
                        for i, last in self.ends[v]:
                            matches.setdefault(i, []).append((e - n, last - n + 1, n))
                    while v and to is None:
                        v = link[v]
                        n = length[v]
                        to = nxt[v].get(tok)
                    if to is None:
                        n = 0
                        continue
                v, n = to, n + 1
                places += [(e - size + 1, k) for k, size in suffixes[v] if n >= size]
        covers = {}
        for i, found in matches.items():
            label, words_ = self.templates[i]
            covers[label] = max(covers.get(label, 0.0), _chain(found) / len(words_))
        base = {self.phrases[k][1] for _, k in places}
        own = {label for label, c in covers.items() if c >= MIN_COVER}
        score = max([float(bool(base)), *covers.values()], default=0.0)
        at = [p for p, _ in places]
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score


def _chain(found: list[tuple[int, int, int]]) -> int:
    """Most words of a template that matches (file place, template place, length) cover, in order, with small gaps."""
    found = sorted(set(found))
    best = [n for _, _, n in found]
    for j, (x, y, n) in enumerate(found):
        for i in range(j - 1, -1, -1):
            x0, y0, n0 = found[i]
            if x - x0 > MAX_GAP + 200:
                break
            over = max(0, x0 + n0 - x, y0 + n0 - y)
            if x > x0 and y > y0 and over < n and x - x0 - n0 <= MAX_GAP and y - y0 - n0 <= MAX_GAP:
                best[j] = max(best[j], best[i] + n - over)
    return max(best)


@cache
def scanner() -> Scanner:
    return Scanner()


def licence_scan(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scanner()
        for b in it:
            rows = list(zip(*map(tool.scan, blobs(b, "text")), strict=True)) or [[]] * (len(schema) - 1)
            yield from arrow_rows({"doc_id": b.column(0)} | dict(zip(schema.names[1:], rows, strict=True)), schema)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_licence_scan": op10_licence_scan}
