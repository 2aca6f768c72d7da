"""The drift pipeline: load, distributions, configuration, drift, save; for tables here, for workloads in plans.features.

make_drift() runs any processor with these five steps. A table's columns are drifted one by one: each is classified,
binned (or taken on the bins of a given configuration), its target solved at the wanted distance, and every row draws a
new value from hashes of its key, so the result is the same under any partitioning. Other columns stay as they are.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftforge.functions.twin import Twins
from driftforge.operators.distributions import categorical_on, classify, equi_width, int_edges, int_equi_width, on_intervals
from driftforge.operators.drift import drawn_in_bins, few_categories, js, place_of, solve, uniform


class Processor(Protocol):
    config: dict[str, Any]

    def load(self, source: Any) -> None: ...
    def compute_dists(self) -> None: ...
    def apply_drift(self, drift: float, n_samples: int | None = None) -> None: ...
    def save(self, path: str) -> None: ...


@dataclass
class Column:
    """One column's bins: categories, or intervals (starts, ends) of floating or whole numbers; p in falling order."""

    kind: str
    values: list
    p: list[float]
    q: list[float] = field(default_factory=list)
    feasible: bool = True


class TableDrift:
    def __init__(self, columns: Sequence[str], key: str, bins: int = 20, skewed: bool = True, config: dict | None = None, salt: str = "42") -> None:
        self.columns, self.key, self.bins, self.skewed, self.salt = list(columns), key, bins, skewed, salt
        self.config: dict[str, Any] = dict(config or {})
        self.dists: dict[str, Column] = {}
        self.df: DataFrame | None = None
        self.drifted: DataFrame | None = None

    def load(self, source: DataFrame) -> None:
        self.df = source

    def _dist(self, col: str, numeric: bool) -> Column:
        df, known = self.df, self.config.get(col)
        kind = known["type"] if known else "categorical"
        if known and kind == "categorical":
            rows = {r.value: r.p for r in categorical_on(df, col, known["values"]).collect()}
            found = [(v, rows[v]) for v in known["values"]]
        elif known:
            edges = [known["values"][0]["start"], *(x["end"] for x in known["values"])]
            rows = {r.bin: r.p for r in on_intervals(df, col, [float(e) for e in edges]).collect()}
            found = [((x["start"], x["end"]), rows.get(i, 0.0)) for i, x in enumerate(known["values"])]
        elif not numeric:
            found = [(r.value, r.p) for r in few_categories(df, col)]
        elif dict(df.dtypes)[col] in ("tinyint", "smallint", "int", "bigint"):
            kind = "int"
            low, high = df.agg(F.min(col), F.max(col)).first()
            edges = int_edges(low, high, self.bins)
            rows = {r.bin: r.p for r in int_equi_width(df, col, self.bins).collect()}
            found = [((a if i else a - 1, b), rows[i]) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        else:
            kind = "float"
            low, high = (float(x) for x in df.agg(F.min(col), F.max(col)).first())
            rows = {r.bin: r.p for r in equi_width(df, col, self.bins).collect()}
            step = (high - low) / self.bins
            found = [((low + i * step, low + (i + 1) * step), rows.get(i, 0.0)) for i in range(self.bins)]
        found.sort(key=lambda x: -x[1])
        total = sum(p for _, p in found) or 1.0
        return Column(kind, [v for v, _ in found], [p / total for _, p in found])

    def compute_dists(self) -> None:
        numeric = {r.col: r.numeric_col for r in classify(self.df, self.columns).collect()}
        for c in self.columns:
            self.dists[c] = d = self._dist(c, numeric[c])
            self.config[c] = {"type": d.kind, "values": d.values if d.kind == "categorical" else [{"start": a, "end": b} for a, b in sorted(d.values)]}

    def apply_drift(self, drift: float, n_samples: int | None = None) -> None:
        if not 0 <= drift <= 1:
            raise ValueError("a drift is between 0 and 1")
        if n_samples is not None:
            raise ValueError("a table keeps its rows")
        new = {}
        for c, d in self.dists.items():
            q, d.feasible = solve(d.p, drift, self.skewed)
            d.q = q.tolist()
            if not d.values:
                continue
            u, v = uniform(self.key, f"{self.salt}:{c}:u"), uniform(self.key, f"{self.salt}:{c}:v")
            if d.kind == "categorical":
                new[c] = F.element_at(F.array(*map(F.lit, d.values)), place_of(u, d.q) + 1)
            else:
                new[c] = drawn_in_bins(u, d.q, [a for a, _ in d.values], [b for _, b in d.values], d.kind == "int", v)
            new[c] = new[c].cast(self.df.schema[c].dataType)
        self.drifted = self.df.withColumns(new) if new else self.df

    def realised(self) -> DataFrame:
        """col, bins, feasible, solved, realised: distances of the target, and of the drifted table, from the table."""
        out = []
        for c, d in self.dists.items():
            got = TableDrift([c], self.key, self.bins, self.skewed, {c: self.config[c]})
            got.load(self.drifted)
            got.compute_dists()
            there = dict(zip(map(str, got.dists[c].values), got.dists[c].p, strict=True))
            now = np.array([there[str(v)] for v in d.values])
            out.append((c, len(d.values), bool(d.feasible), js(np.array(d.p), np.array(d.q)), js(np.array(d.p), now)))
        return self.df.sparkSession.createDataFrame(out, "col string, bins int, feasible boolean, solved double, realised double")

    def save(self, path: str) -> None:
        sep = "|" if path.rstrip("/").endswith(".tbl") else ","
        self.drifted.write.mode("overwrite").option("sep", sep).option("escape", "\\").csv(path)


def make_drift(processor: Processor, source: Any, output_path: str, config_path: str, drift: float, n_samples: int | None = None) -> dict[str, float]:
    """Runs a processor's steps, writes its result and its configuration (JSON), and gives the seconds of each step."""
    if source is None:
        raise ValueError("nothing to load")
    took = {}
    for name, step in (("load", lambda: processor.load(source)), ("dists", processor.compute_dists), ("config", lambda: _dump(processor.config, config_path)), ("drift", lambda: processor.apply_drift(drift, n_samples)), ("save", lambda: processor.save(output_path))):
        began = time.time()
        step()
        took[name] = time.time() - began
    return took


def _dump(config: dict, path: str) -> None:
    """One indented document: a few bins a column."""
    with open(path, "w") as f:
        json.dump(config, f, indent=4, default=str)


def drifted_table(df: DataFrame, columns: Sequence[str], key: str, drift: float, **how) -> DataFrame:
    made = TableDrift(columns, key, **how)
    made.load(df)
    made.compute_dists()
    made.apply_drift(drift)
    return made.drifted


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift of all columns of `orders` that may be drifted, and what was reached."""
    made = TableDrift(["o_orderstatus", "o_totalprice", "o_orderpriority"], "o_orderkey")
    made.load(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    made.compute_dists()
    made.apply_drift(0.3)
    return made.realised().withColumns({c: F.round(c, 9) for c in ("solved", "realised")})


T = Twins()
T.frame("drift_table_orders", lambda s, d: drifted_table(s.read.parquet(f"{d}/orders.parquet"), ["o_orderstatus", "o_totalprice", "o_orderpriority"], "o_orderkey", 0.3))
T.frame("drift_table_part", lambda s, d: drifted_table(s.read.parquet(f"{d}/part.parquet"), ["p_size", "p_type", "p_brand", "p_retailprice"], "p_partkey", 0.5, skewed=False))
T.frame("drift_report", drift_report)
QUERIES, ORACLES = T.queries, T.oracles
