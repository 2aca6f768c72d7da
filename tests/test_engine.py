import hashlib
import math
import random
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest

from driftforge import registry
from driftforge.operators import drift
from driftforge.plans import experience, joinorder, shapes, workload
from driftforge.sources import files
from driftforge.streaming.monitor import windowed_counts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    text = lambda v: repr(float(v)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def test_entry_runs(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark).collect()
    assert {r.col for r in got} == {"o_orderstatus", "o_totalprice", "o_orderpriority"} and all(abs(r.solved - 0.3) < 1e-6 for r in got)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_matches_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracles()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.collect(), df.columns) == _rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("skewed", [True, False])
@pytest.mark.parametrize("n", [3, 5, 20, 200])
@pytest.mark.parametrize("d", [0.1, 0.3, 0.5, 0.7])
def test_solver_meets_the_distance(n, d, skewed):
    p = np.sort(np.random.default_rng(n).dirichlet(np.ones(n)))[::-1]
    q, feasible = drift.solve(p, d, skewed)
    assert q.min() >= -1e-12 and abs(q.sum() - 1) < 1e-9
    if feasible:
        assert abs(drift.js(p, q) - d) < 1e-9


def test_solver_limits():
    assert drift.solve([0.5, 0.5], 0)[0].tolist() == [0.5, 0.5]
    assert not drift.solve([0.6, 0.4], 0.9)[1] and drift.MOST < 0.8326


def test_resample_and_quota(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    out = drift.resample_categorical(orders, "o_orderpriority", "o_orderkey", 0.3)
    assert out.count() == orders.count()
    quota = {r.o_orderpriority: 7 for r in orders.select("o_orderpriority").distinct().collect()}
    assert {r["count"] for r in drift.quota_sample(orders, "o_orderpriority", "o_orderkey", quota).groupBy("o_orderpriority").count().collect()} == {7}


def test_join_order_searches():
    rng = random.Random(3)
    for _ in range(5):
        names = [f"t{i}" for i in range(6)]
        edges = {frozenset((names[i], names[rng.randrange(i)])): rng.random() / 50 for i in range(1, 6)}
        g = joinorder.Graph({n: rng.randrange(10, 10_000) for n in names}, edges)
        best = joinorder.dp(g)[0]
        for cost, tree in (joinorder.dp(g, True), joinorder.beam(g), joinorder.mcts(g), joinorder.random_search(g, 50)):
            assert joinorder.leaves(tree) == frozenset(names) and cost >= best * (1 - 1e-9) and math.isclose(cost, joinorder.c_out(tree, g))


def test_metadata(spark):
    m = workload.metadata(spark, "select a.x from orders a, lineitem b where b.k = a.k and 5 > a.z and exists (select * from part p where p.q = b.q)")
    assert m.tables == {"orders", "lineitem", "part"} and m.aliases == {"a": "orders", "b": "lineitem", "p": "part"}
    assert m.joins == {("a.k", "=", "b.k"), ("b.q", "=", "p.q")} and m.predicates == {("a.z", "<", "5")}


def test_rank_scores_beyond_32_bits(spark, tmp_path):
    """Ranks whose fourth power passes 32 bits, and balances that are null (last in SQL)."""
    spark.range(50_000).selectExpr("id c_custkey", "cast(id < 300 as int) c_nationkey", "if(id % 100 = 7, null, -id / 2D) c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.queries()["rank_score"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = con.sql(registry.oracles()["rank_score"])
    assert _rows(got.collect(), got.columns) == _rows(want.fetchall(), want.columns)
    assert got.orderBy("rk").tail(1)[0].rk4 == 49_700**4


def test_files(spark, tmp_path):
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    files.write_delimited(nation, f"{tmp_path}/n", "|")
    back = files.read_delimited(spark, f"{tmp_path}/n", "a int, b string, c int", "|")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, nation.collect()))
    files.tbl_to_csv(spark, f"{tmp_path}/n", f"{tmp_path}/c", "a int, b string, c int")
    assert files.read_delimited(spark, f"{tmp_path}/c", "a int, b string, c int", header=True).count() == nation.count()
    (tmp_path / "q").mkdir()
    (tmp_path / "q/1.sql").write_text("-- one\nSELECT 'A'\n FROM t; select 2;")
    got = files.read_sql_folder(spark, f"{tmp_path}/q")
    assert [r.sql for r in got.orderBy("ordinal").collect()] == ["SELECT 'A' FROM t", "select 2"]
    files.write_merged_workload(got.selectExpr("concat('q', ordinal) id", "sql"), f"{tmp_path}/m")
    assert {(r.id, r.sql) for r in files.read_merged_workload(spark, f"{tmp_path}/m").collect()} == {("q0", "SELECT 'A' FROM t"), ("q1", "select 2")}
    assert files.workload_json(got.selectExpr("'x' id", "sql")).count() == 2


def test_keys(spark, tmp_path):
    keys = [3, 2**64 - 1, 7]
    df = spark.createDataFrame([(str(k),) for k in keys], "key string").selectExpr("cast(key as decimal(20,0)) key")
    assert files.write_keys(df, f"{tmp_path}/k_uint64") == 3
    assert [int(r.key) for r in files.read_keys(spark, f"{tmp_path}/k_uint64").collect()] == sorted(keys)
    (tmp_path / "bad_uint64").write_bytes(struct.pack("<QQ", 2, 1))
    with pytest.raises(Exception, match="header says"):
        files.read_keys(spark, f"{tmp_path}/bad_uint64").collect()


def test_monitor(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert windowed_counts(events).selectExpr("sum(n) n").first().n == events.count()


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "select 1"), ("b", "select 2, 'x,y'")], "id string, sql string")
    files.write_json(df, f"{tmp_path}/j")
    assert {tuple(r) for r in spark.read.schema(df.schema).json(f"{tmp_path}/j").collect()} == {tuple(r) for r in df.collect()}
    files.write_query_files(df, f"{tmp_path}/q")
    assert {(r.id, r.value) for r in spark.read.text(f"{tmp_path}/q").collect()} == {tuple(r) for r in df.collect()}
    files.write_delimited(df, f"{tmp_path}/c")
    files.with_header(spark, f"{tmp_path}/c", f"{tmp_path}/h", ["one", "two"])
    assert sorted(map(tuple, files.read_delimited(spark, f"{tmp_path}/h", "one string, two string", header=True).collect())) == sorted(map(tuple, df.collect()))


def test_shapes(spark):
    rows = {r.shape: r for r in shapes.shape_stats(shapes.plan_rows(spark, [("x", (("a", "b"), "c"), 3.0), ("y", (("a", "b"), ("c", "d")), 5.0)])).collect()}
    assert sum(r.plans for r in rows.values()) == 2 and {(r.scans, r.joins, r.share) for r in rows.values()} == {(3.0, 2.0, 0.5), (4.0, 3.0, 0.5)}


def test_sql_normalise_takes_whole_texts(spark, tmp_path):
    def plain(text):  # qpre.py: comment lines go, white space is squeezed, all is lower case
        return text and " ".join("\n".join(x for x in text.split("\n") if not x.strip().startswith("--")).split()).lower()

    texts = [None, "", "--", "-- A\n--B\n\t -- C\nSELECT  1\n --d", "a\r--B\n\r--c\r\nD -- e", "\x85X\xa0 y\x0b\x1c-- Z", "\n\n--\n\n--A\n-B - -", "Word\t" * 400 + "\n--gone " + "x" * 300 + "\nTHE END"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {i: plain(x) for i, x in enumerate(texts)}
    assert {r.doc_id: r.t for r in registry.queries()["sql_normalise"](spark, str(tmp_path)).collect()} == want
    assert dict(con.sql(registry.oracles()["sql_normalise"]).fetchall()) == want
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.t for r in registry.queries()["sql_normalise"](spark, SF).collect()} == docs


def test_key_bins_are_filled_over_all_keys(spark, tmp_path):
    keys = [1, 5, 699, 700, 1400, 1500, 1600, 2999, 3000, 7100, 7100, 9999]  # no key in bins 3, 5 to 9 and 11 to 13
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.bin: r.cnt for r in registry.queries()["dist_keybins_filled"](spark, str(tmp_path)).collect()}
    assert got == {b: len({k for k in keys if k // 700 == b}) for b in range(15)}
    for sf in (SF, "/root/testdata/sf0.01"):
        assert registry.queries()["dist_keybins_filled"](spark, sf).selectExpr("sum(cnt) n").first().n == spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").distinct().count()


def _nearest(rows, k):
    out = {}
    for i, x in rows:
        if x is not None:
            d = sorted(abs(x - y) for j, y in rows if j != i and y is not None)[:k]
            out[i] = round(sum(d) / len(d), 6) if d else None
    return out


def test_nearest_neighbours(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, round(rng.choice([rng.gauss(0, 5), 10 ** rng.uniform(0, 9), 7.0]), 2)) for i in range(300)] + [(300, None), (301, -5e9)]
    for some in (rows, rows[:5], rows[:1], rows[300:]):
        df = spark.createDataFrame(some, "i long, v double")
        for block in (7, 64, 4096):
            got = {r.id: r.unc for r in experience.neighbour_distance(df, "i", "v", 3, block).collect()}
            want = _nearest(some, 3)
            assert got.keys() == want.keys() and all(got[i] == want[i] or math.isclose(got[i], want[i], abs_tol=2e-6, rel_tol=1e-12) for i in want)
    for sf in (SF, "/root/testdata/sf0.01"):
        want = _nearest([tuple(r) for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_acctbal").collect()], 10)
        got = {r.id: r.unc for r in registry.queries()["knn_uncertainty"](spark, sf).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=2e-6) for i in want)


def test_random_search_draws_a_thousand_plans(spark, monkeypatch):
    drawn, draw = [], joinorder.random_plan
    monkeypatch.setattr(joinorder, "random_plan", lambda g, rng: drawn.append(draw(g, rng)) or drawn[-1])
    got = {r.method: r.cost for r in joinorder.plan_search(spark, SF).collect()}
    assert len(drawn) == 1001  # tree search begins with one
    assert got["random"] == round(min(c for c, _ in drawn[1:]), 3)
    assert registry.queries()["plan_shape_stats"](spark, SF).selectExpr("sum(plans) n").first().n == 1000


def test_cross_join_is_the_whole_product(spark):
    regions, nations = ([r[0] for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c).collect()] for t, c in (("region", "r_name"), ("nation", "n_name")))
    assert sorted(map(tuple, registry.queries()["cross_join"](spark, SF).select("r_name", "n_name").collect())) == sorted((r, n) for r in regions for n in nations)


def test_drifted_workload_draws_from_all_suite_queries(spark):
    named = {}
    for r in workload.suite_features(spark, SF).where("kind = 'table'").collect():
        named.setdefault(r.feature, []).append(r.id)
    assert {i for ids in named.values() for i in ids} == {k for k in registry.oracles() if k.startswith(("tpch_", "job_"))}
    uniform = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16) / 2**32
    order = sorted(named, key=lambda f: (-len(named[f]), f))
    weights = np.array([1 / k for k in range(1, len(order) + 1)])
    upper = np.cumsum(weights / weights.sum())
    upper[-1] = 1.0
    want = Counter()
    for i in range(500):
        feature = order[int(np.searchsorted(upper, uniform(f"wq:{i}"), "right"))]
        want[sorted(named[feature])[int(uniform(f"wr:{i}") * len(named[feature]))], feature] += 1
    assert {(r.id, r.feature): r.drawn for r in registry.queries()["wl_drift_sample"](spark, SF).collect()} == dict(want)
