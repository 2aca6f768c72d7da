"""What a query names, read from Catalyst's own parse tree: tables, aliases, join and constant predicates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftforge.functions.twin import Twins

_COMPARE = {"EqualTo": "=", "LessThan": "<", "GreaterThan": ">", "LessThanOrEqual": "<=", "GreaterThanOrEqual": ">="}
_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}


@dataclass
class Metadata:
    tables: set[str] = field(default_factory=set)
    aliases: dict[str, str] = field(default_factory=dict)
    joins: set[tuple[str, str, str]] = field(default_factory=set)  # column, operator, column: the lesser name first
    predicates: set[tuple[str, str, str]] = field(default_factory=set)  # column, operator, constant


def _tree(nodes: list[dict]) -> dict:
    """Catalyst lists a tree in pre-order with child counts."""
    it = iter(nodes)

    def build() -> dict:
        node = next(it)
        return node | {"children_": [build() for _ in range(node.get("num-children", 0))]}

    return build()


def _names(value) -> str | None:
    return value.strip("[]").replace(", ", ".").replace("`", "") if isinstance(value, str) else ".".join(value)


def metadata(spark: SparkSession, sql: str) -> Metadata:
    plan = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON())
    out = Metadata()

    def side(node: dict) -> tuple[str, str] | None:
        kind = node["class"].rpartition(".")[2]
        if kind == "UnresolvedAttribute":
            return "column", _names(node["nameParts"])
        if kind == "Literal":
            return "constant", str(node.get("value"))
        if kind in ("Cast", "UnaryMinus") and node["children_"]:
            got = side(node["children_"][0])
            return got if got and got[0] == "constant" else None
        return None

    def walk(node: dict, alias: str | None = None) -> None:
        kind = node["class"].rpartition(".")[2]
        if kind == "UnresolvedRelation":
            name = _names(node["multipartIdentifier"])
            out.tables.add(name)
            out.aliases[alias or name] = name
        elif kind in _COMPARE:
            a, b = (side(x) for x in node["children_"])
            op = _COMPARE[kind]
            if a and b and a[0] == b[0] == "column":
                left, op, right = (a[1], op, b[1]) if a[1] <= b[1] else (b[1], _FLIP[op], a[1])
                out.joins.add((left, op, right))
            elif a and b and a[0] == "column":
                out.predicates.add((a[1], op, b[1]))
            elif a and b and b[0] == "column":
                out.predicates.add((b[1], _FLIP[op], a[1]))
        name = node.get("identifier", {}).get("name") if kind == "SubqueryAlias" and isinstance(node.get("identifier"), dict) else None
        for x in node["children_"]:
            walk(x, name)
        for value in (v for k, v in node.items() if k != "children_"):  # expressions and subquery plans are trees of their own
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, list) and x and isinstance(x[0], dict) and "num-children" in x[0]:
                    walk(_tree(x))
            if isinstance(value, list) and value and isinstance(value[0], dict) and "num-children" in value[0]:
                walk(_tree(value))

    walk(_tree(plan))
    return out


def workload_features(spark: SparkSession, queries: dict[str, str]) -> DataFrame:
    """id, kind (table, alias, join, predicate), feature: one row for each thing a query names."""
    rows = []
    for name, sql in sorted(queries.items()):
        m = metadata(spark, sql)
        rows += [(name, "table", t) for t in sorted(m.tables)] + [(name, "alias", f"{a}={t}") for a, t in sorted(m.aliases.items())]
        rows += [(name, "join", " ".join(j)) for j in sorted(m.joins)] + [(name, "predicate", " ".join(p)) for p in sorted(m.predicates)]
    return spark.createDataFrame(rows, "id string, kind string, feature string")


def suite_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftforge.functions.twin import spark_text
    from driftforge.plans.suites import ORACLES

    return workload_features(spark, {k: spark_text(v) for k, v in ORACLES.items() if k.startswith(("tpch_", "job_"))})


T = Twins()
T.frame("wl_tables", lambda s, d: suite_features(s, d).where("kind = 'table'").groupBy("feature").agg(F.count(F.lit(1)).alias("n")))
T.frame("wl_joins", lambda s, d: suite_features(s, d).where("kind = 'join'").groupBy("feature").agg(F.count(F.lit(1)).alias("n")))
T.frame("wl_predicates", lambda s, d: suite_features(s, d).where("kind = 'predicate'").select("id", "feature"))
T.frame("wl_feature_dist", lambda s, d: suite_features(s, d).groupBy("id", "kind").agg(F.to_json(F.array_sort(F.collect_set("feature"))).alias("features")).groupBy("kind", "features").agg(F.count(F.lit(1)).alias("n")))
QUERIES, ORACLES = T.queries, T.oracles
