"""Encoders of columns, with their inverses: codes, bits, scalers, normal scores, one-hot; and of latencies and texts.

An encoder is fitted on a table (its parameters are a row, or a row a category) and applied to any table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftforge.functions.running import running, shares
from driftforge.functions.twin import Twins


#: Different values of a column whose curve is sent to every task.
MOST_POINTS = 10_000


@dataclass(frozen=True)
class Scaler:
    """x -> (f(x) - shift) / scale, back by the inverse; f: the number itself or ln(x + 1)."""

    shift: float
    scale: float
    low: float
    high: float
    log: bool = False

    @classmethod
    def fit(cls, df: DataFrame, col: str, kind: str = "minmax") -> Scaler:
        x = F.log1p(col) if kind == "logminmax" else F.col(col)
        low, high, mean, std = df.agg(F.min(x), F.max(x), F.avg(x), F.stddev_pop(x)).first()
        if low is None:
            raise ValueError(f"{col} holds no number")
        shift, scale = (mean, std) if kind == "standard" else (low, high - low)
        return cls(float(shift), float(scale) or 1.0, float(low), float(high), kind == "logminmax")

    def encode(self, col: str) -> Column:
        return ((F.log1p(col) if self.log else F.col(col)) - self.shift) / self.scale

    def decode(self, col: str, digits: int | None = None) -> Column:
        """Clipped to the fitted range; digits 0 gives back whole numbers."""
        x = F.least(F.greatest(F.col(col) * self.scale + self.shift, F.lit(self.low)), F.lit(self.high))
        x = F.expm1(x) if self.log else x
        return x if digits is None else F.round(x, digits)


def probit(p: Column) -> Column:
    """The normal quantile of p in (0, 1), by Newton steps from Winitzki's approximation of the inverse error function."""
    y = 2 * p - 1
    a, ln = 0.147, F.log(1 - y * y)
    k = 2 / (math.pi * a) + ln / 2
    z = F.signum(y) * F.sqrt(F.sqrt(k * k - ln / a) - k) * math.sqrt(2)
    return z


def normal_scores(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, q, z: the share of rows below each row's value, from 0 to 1, and its normal quantile, cut at 1e-7 from either end."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    q = (F.col("upto") - F.col("__n")) / F.nullif(F.col("__all") - 1, F.lit(0))
    codes = running(counts, "__v", {"upto": "__n"}).join(F.broadcast(total), F.lit(True)).select("__v", F.coalesce(q, F.lit(0.0)).alias("q"))
    z = probit(F.least(F.greatest(F.col("q"), F.lit(1e-7)), F.lit(1 - 1e-7)))
    return df.select(key, F.col(col).alias("__v")).join(codes, "__v").select(key, "q", z.alias("z"))


def from_scores(df: DataFrame, score: str, fitted: DataFrame, col: str) -> DataFrame:
    """df with the value of the fitted column whose share is the greatest at or below each score q, the least where none is."""
    curve = shares(fitted, col).select("value", ((F.col("share") - F.col("n") / F.sum("n").over(Window.partitionBy())) * F.sum("n").over(Window.partitionBy()) / F.greatest(F.sum("n").over(Window.partitionBy()) - 1, F.lit(1))).alias("q"))
    points = [(r.value, r.q) for r in curve.orderBy("q").limit(MOST_POINTS + 1).collect()]
    if not 0 < len(points) <= MOST_POINTS:
        raise ValueError(f"{col} has no value or more than {MOST_POINTS} different ones: bin it first")
    values, at = F.array(*[F.lit(v) for v, _ in points]), F.array(*[F.lit(float(q)) for _, q in points])
    return df.withColumn(col, F.element_at(values, F.greatest(F.size(F.filter(at, lambda q: q <= F.col(score) + 1e-12)), F.lit(1))))


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """value, code: categories in ascending order from 0; one row a category."""
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct().withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))


def encode_categories(df: DataFrame, col: str, codes: DataFrame, out: str = "code") -> DataFrame:
    """df with the category's code, -1 where it is unknown."""
    return df.join(codes.select(F.col("value").alias(col), F.col("code").alias(out)), col, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def decode_categories(df: DataFrame, code: str, codes: DataFrame, out: str) -> DataFrame:
    """df with the category of a code; codes outside the dictionary give null."""
    return df.join(codes.select(F.col("code").alias(code), F.col("value").alias(out)), code, "left")


def width(categories: int) -> int:
    return max(1, math.ceil(math.log2(max(2, categories))))


def to_bits(code: str, bits: int) -> Column:
    """The code's bits, most significant first."""
    return F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), lambda i: F.getbit(F.col(code).cast("long"), i).cast("int"))


def from_bits(bits: str) -> Column:
    return F.aggregate(bits, F.lit(0), lambda a, b: a * 2 + b)


def one_hot(col: str, values: Sequence) -> Column:
    """An array with 1 at the value's place, all 0 for others and nulls."""
    return F.array(*[F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)) for v in values])


@dataclass(frozen=True)
class Wrapper:
    """Several encoders as one: numbers first, then the bits of categories, in one array; and back, in the table's order."""

    scalers: dict[str, Scaler]
    values: dict[str, list]

    @classmethod
    def fit(cls, df: DataFrame, numbers: Sequence[str], categories: Sequence[str], most: int = 10_000) -> Wrapper:
        values = {}
        for c in categories:
            values[c] = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(most + 1).collect()]
            if len(values[c]) > most:
                raise ValueError(f"{c} has more than {most} categories: bin it first")
        return cls({c: Scaler.fit(df, c) for c in numbers}, values)

    def encode(self, df: DataFrame, out: str = "encoded") -> DataFrame:
        parts = [F.array(*[s.encode(c) for c, s in self.scalers.items()])]
        for c, values in self.values.items():
            code = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(c)), F.lit(0)) - 1, F.lit(len(values)))
            bits = width(len(values) + 1)
            parts.append(F.array(*[F.getbit(code.cast("long"), F.lit(i)).cast("double") for i in reversed(range(bits))]))
        return df.withColumn(out, F.concat(*parts))

    def decode(self, df: DataFrame, encoded: str = "encoded", order: Sequence[str] | None = None) -> DataFrame:
        """Columns from the array: bits rounded, codes outside the dictionary null."""
        out, at = {}, 0
        for c, s in self.scalers.items():
            out[c] = F.least(F.greatest(F.col(encoded)[at] * s.scale + s.shift, F.lit(s.low)), F.lit(s.high))
            at += 1
        for c, values in self.values.items():
            bits = width(len(values) + 1)
            code = sum((F.round(F.col(encoded)[at + i]).cast("int") * (1 << (bits - 1 - i)) for i in range(bits)), F.lit(0))
            out[c] = F.try_element_at(F.array(*map(F.lit, values)), code + 1)
            at += bits
        return df.select(*[x for x in df.columns if x != encoded and x not in out], *[out[c].alias(c) for c in (order or out)])


def latency_code(ms: Column, most: float, steps: int = 200) -> Column:
    """Latency on a logarithmic scale of `steps` up to `most`."""
    return F.least(F.round(F.log1p(ms) / math.log1p(most) * steps), F.lit(steps)).cast("int")


def latency_of(code: Column, most: float, steps: int = 200) -> Column:
    return F.expm1(code / steps * math.log1p(most))


def human(n: Column) -> Column:
    """1234 -> 1K, 5e6 -> 5M, 7e9 -> 7G: cut, not rounded."""
    cut = lambda d, unit: F.concat(F.floor(n / d).cast("long").cast("string"), F.lit(unit))
    return F.when(n >= 1e9, cut(1e9, "G")).when(n >= 1e6, cut(1e6, "M")).when(n >= 1e3, cut(1e3, "K")).otherwise(F.floor(n).cast("long").cast("string"))


def query_ident(name: Column) -> Column:
    """The name of a query file as an ident that sorts: queries/1a.sql -> 01a."""
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.sql$", "")
    return F.concat(F.lpad(F.regexp_extract(base, r"^(\d*)", 1), 2, "0"), F.regexp_extract(base, r"^\d*(.*)$", 1))


T = Twins()
_t = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
T.both("enc_neg_log_sel", "SELECT event_type, round(-ln(count(*) / (SELECT count(*) FROM events)), 9) AS nls FROM events GROUP BY 1")
T.both("md5_key", "SELECT n_nationkey, md5(n_name) AS k FROM nation")
# lines that begin with -- go, runs of white space (as Python's str.split knows it) become one space; a line starts at \n only
_GAP = "\\t-\\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PLAIN = "SELECT doc_id, lower(trim(regexp_replace(regexp_replace(chr(10) || text, '\\n[{gap}]*--[^\\n]*', ''{all}), '[{gap}]+', ' '{all}))) AS t FROM documents"
T.both("sql_normalise", _PLAIN.format(gap=_GAP, all=""), _PLAIN.format(gap=_GAP, all=", 'g'"))
for _name, _kind, _tab, _key, _col, _digits, _sql in (
    ("enc_minmax", "minmax", "customer", "c_custkey", "c_acctbal", 9, "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 9) AS x FROM customer"),
    ("enc_standard", "standard", "customer", "c_custkey", "c_acctbal", 6, "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS x FROM customer"),
    ("enc_logminmax", "logminmax", "orders", "o_orderkey", "o_totalprice", 9, "WITH l AS (SELECT o_orderkey, ln(o_totalprice + 1) AS v FROM orders) SELECT o_orderkey, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 9) AS x FROM l"),
):
    T.frame(_name, lambda s, d, k=_kind, t=_tab, key=_key, c=_col, g=_digits: (lambda df: df.select(key, F.round(Scaler.fit(df, c, k).encode(c), g).alias("x")))(_t(s, d, t)), _sql)
T.frame("enc_inverse", lambda s, d: (lambda df, f: df.withColumn("x", f.encode("c_acctbal")).select("c_custkey", f.decode("x", 2).alias("back")))(*(lambda df: (df, Scaler.fit(df, "c_acctbal", "standard")))(_t(s, d, "customer"))), "SELECT c_custkey, round(c_acctbal, 2) AS back FROM customer")
T.frame("enc_quantile", lambda s, d: normal_scores(_t(s, d, "orders"), "o_orderkey", "o_totalprice").select("o_orderkey", F.round("q", 9).alias("q")), "SELECT o_orderkey, round(percent_rank() OVER (ORDER BY o_totalprice), 9) AS q FROM orders")
T.frame("enc_ordinal", lambda s, d: encode_categories(_t(s, d, "part"), "p_type", dictionary(_t(s, d, "part").where("p_size <= 40"), "p_type")).select("p_partkey", "code"), "WITH k AS (SELECT DISTINCT p_type FROM part WHERE p_size <= 40) SELECT p_partkey, CAST(CASE WHEN p_type IN (SELECT p_type FROM k) THEN (SELECT count(*) FROM k WHERE k.p_type < part.p_type) ELSE -1 END AS INT) AS code FROM part")
T.frame("enc_bits", lambda s, d: (lambda k: k.select("value", F.array_join(to_bits("code", 5), "").alias("bits"), from_bits("b").alias("back")))(dictionary(_t(s, d, "part"), "p_brand").withColumn("b", to_bits("code", 5))), "WITH k AS (SELECT v AS value, rank() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT p_brand AS v FROM part) x) SELECT value, lpad(bin(c), 5, '0') AS bits, CAST(c AS INT) AS back FROM k")
T.frame("enc_onehot", lambda s, d: (lambda df, v: df.select("event_id", F.array_join(one_hot("event_type", v), "").alias("hot")))(*(lambda df: (df, [r[0] for r in dictionary(df, "event_type").orderBy("code").limit(1000).collect()]))(_t(s, d, "events"))), "WITH k AS (SELECT DISTINCT event_type AS v FROM events) SELECT event_id, (SELECT string_agg(CASE WHEN v = event_type THEN '1' ELSE '0' END, '' ORDER BY v) FROM k) AS hot FROM events")
T.frame("enc_latency", lambda s, d: _t(s, d, "events").select("event_id", latency_code(F.abs("value"), 299.0).alias("code"), F.round(latency_of(latency_code(F.abs("value"), 299.0), 299.0), 6).alias("back")), "WITH c AS (SELECT event_id, CAST(least(round(ln(abs(value) + 1) / ln(300) * 200), 200) AS INT) AS code FROM events) SELECT event_id, code, round(pow(300, code / 200) - 1, 6) AS back FROM c")
T.frame("human_counts", lambda s, d: _t(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).select("o_custkey", human(F.col("t")).alias("h"), human(F.col("t") * 10000).alias("big")), "WITH s AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT o_custkey, regexp_extract(CAST(CAST(floor(t / pow(1000, least(3, floor(log10(t) / 3)))) AS BIGINT) AS VARCHAR), '.*') || CASE WHEN t >= 1e9 THEN 'G' WHEN t >= 1e6 THEN 'M' WHEN t >= 1e3 THEN 'K' ELSE '' END AS h, CAST(CAST(floor(t * 10000 / pow(1000, least(3, floor(log10(t * 10000) / 3)))) AS BIGINT) AS VARCHAR) || CASE WHEN t * 10000 >= 1e9 THEN 'G' WHEN t * 10000 >= 1e6 THEN 'M' WHEN t * 10000 >= 1e3 THEN 'K' ELSE '' END AS big FROM s")
T.frame("query_ident", lambda s, d: _t(s, d, "nation").select("n_nationkey", query_ident(F.concat(F.lit("queries/"), F.col("n_nationkey").cast("string"), F.lit("a.sql"))).alias("ident")), "SELECT n_nationkey, printf('%02da', n_nationkey) AS ident FROM nation")
QUERIES, ORACLES = T.queries, T.oracles
