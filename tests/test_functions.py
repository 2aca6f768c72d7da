"""Functions with parameters against numpy and plain loops."""

import json
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftforge.functions import running
from driftforge.operators import distributions, drift, encoders, evaluation, matrices, pipeline
from driftforge.plans import arms, experience, explain, features, joinorder
from driftforge.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1.5, 2.5, 3.5, None]) if i % 3 else rng.gauss(0, 5), rng.randrange(40), rng.choice("abcde"), None if i % 11 == 0 else rng.random()) for i in range(500)]
    return spark.createDataFrame(rows, "id long, x double, k int, c string, y double").repartition(5)


def test_running_sums_and_ranks(spark, numbers):
    got = {r.id: (r.s, r.m) for r in running.running(numbers.where("y is not null"), "id", {"s": "k"}, {"m": "y"}, 7).collect()}
    s, m = 0, math.inf
    for r in sorted(numbers.where("y is not null").collect(), key=lambda r: r.id):
        s, m = s + r.k, min(m, r.y)
        assert got[r.id] == (s, m)
    x = np.array([r.x for r in numbers.collect() if r.x is not None])
    for r in running.average_ranks(numbers, "x").collect():
        assert r["rank"] == (x < r["value"]).sum() + ((x == r["value"]).sum() + 1) / 2
    for r in running.shares(numbers, "x").collect():
        assert math.isclose(r.share, (x <= r["value"]).mean())
    assert running.running(numbers.limit(0), "id", {"s": "k"}).count() == 0


def test_bins(spark, numbers):
    rows = numbers.collect()
    got = {r.bin: (r.cnt, r.p) for r in distributions.equi_width(numbers, "x", 6).collect()}
    x = np.array([r.x for r in rows if r.x is not None])
    want = np.histogram(-x, bins=6)[0][::-1]  # right-closed bins
    assert [got.get(i, (0, 0))[0] for i in range(6)] == want.tolist()
    assert math.isclose(sum(p for _, p in got.values()), len(x) / len(rows))  # nulls stay in the denominator
    k = [r.k for r in rows]
    edges = distributions.int_edges(min(k), max(k), 7)
    for r in distributions.int_equi_width(numbers, "k", 7).collect():
        inside = sum(edges[r.bin] < v <= edges[r.bin + 1] or (r.bin == 0 and v == edges[0]) for v in k)
        assert (r.start, r.end, r.cnt) == (edges[r.bin], edges[r.bin + 1], inside) and math.isclose(r.p, inside / len(k))
    with pytest.raises(ValueError, match="whole bins"):
        distributions.int_equi_width(numbers.selectExpr("k % 3 as k"), "k", 7)
    assert {r.col: r.numeric_col for r in distributions.classify(numbers).collect()} == {"id": True, "x": True, "k": True, "c": False, "y": True}


def test_matrices(spark, numbers):
    rows = [r for r in numbers.collect() if r.x is not None and r.y is not None]
    a = np.array([[r.x, r.k, r.y] for r in rows])
    full = numbers.where("x is not null and y is not null")
    want = np.corrcoef(a.T)
    got = {(r.a, r.b): r.r for r in matrices.pearson(full, ["x", "k", "y"]).collect()}
    assert np.allclose([got["x", "k"], got["x", "y"], got["k", "y"]], [want[0, 1], want[0, 2], want[1, 2]])
    rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
    want = np.corrcoef(np.array([rank(v) for v in a.T]))
    got = {(r.a, r.b): r.r for r in matrices.spearman(full, ["x", "k", "y"]).collect()}
    assert np.allclose([got["x", "k"], got["x", "y"], got["k", "y"]], [want[0, 1], want[0, 2], want[1, 2]])
    one, two = np.sort(a[:150, 0]), np.sort(a[150:, 0])
    at = np.concatenate((one, two))
    ks = np.abs(np.searchsorted(one, at, "right") / len(one) - np.searchsorted(two, at, "right") / len(two)).max()
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    got = matrices.ks_two_sample(frame(one), frame(two), "x").first()
    assert math.isclose(got.ks, ks) and 0 <= got.p <= 1
    kept, removed = matrices.split_outliers(numbers, "x")
    assert kept.count() + removed.count() == 500 and removed.where("x is null").count() == sum(r.x is None for r in numbers.collect())


def test_encoders_go_and_come_back(spark, numbers):
    for kind in ("minmax", "standard"):
        s = encoders.Scaler.fit(numbers, "x", kind)
        back = numbers.where("x is not null").withColumn("e", s.encode("x")).withColumn("b", s.decode("e"))
        assert back.where("abs(b - x) > 1e-9").count() == 0
    for r in encoders.normal_scores(numbers, "id", "y").collect():
        if 0.001 < r.q < 0.999:
            assert abs(NormalDist().inv_cdf(r.q) - r.z) < 0.01
    scores = encoders.normal_scores(numbers, "id", "y")
    again = encoders.from_scores(scores, "q", numbers, "y").join(numbers.select("id", F.col("y").alias("was")), "id")
    assert again.where("abs(y - was) > 1e-12").count() == 0 and again.count() == scores.count()
    codes = encoders.dictionary(numbers.where("c <> 'e'"), "c")
    coded = encoders.encode_categories(numbers, "c", codes).withColumn("bits", encoders.to_bits("code", 3))
    assert {(r.c, r.code) for r in coded.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", -1)}
    assert coded.where("code >= 0").withColumn("back", encoders.from_bits("bits")).where("back <> code").count() == 0
    assert encoders.decode_categories(coded, "code", codes, "was").where("code >= 0 and was <> c or code < 0 and was is not null").count() == 0
    w = encoders.Wrapper.fit(numbers, ["x", "k"], ["c"])
    full = numbers.where("x is not null")
    back = w.decode(w.encode(full).select("id", "encoded"), order=["c", "k", "x"]).join(full.select("id", F.col("x").alias("x0"), F.col("k").alias("k0"), F.col("c").alias("c0")), "id")
    assert back.count() == full.count() and back.where("abs(x - x0) > 1e-9 or round(k) <> k0 or c <> c0").count() == 0
    got = spark.createDataFrame([("queries/1a.sql",), ("33c.sql",), ("q.sql",)], "n string").select(encoders.query_ident(F.col("n"))).collect()
    assert [r[0] for r in got] == ["01a", "33c", "00q"]


def test_a_table_drifts_to_the_solved_distance(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    made = pipeline.TableDrift(["o_orderpriority", "o_totalprice", "o_orderstatus"], "o_orderkey")
    took = pipeline.make_drift(made, orders, f"{tmp_path}/out.tbl", f"{tmp_path}/bins.json", 0.3)
    assert list(took) == ["load", "dists", "config", "drift", "save"]
    for r in made.realised().collect():
        assert r.feasible and abs(r.solved - 0.3) < 1e-6 and abs(r.realised - 0.3) < 0.03
    assert made.drifted.dtypes == orders.dtypes and made.drifted.count() == orders.count()
    assert made.drifted.select("o_orderkey", "o_custkey").exceptAll(orders.select("o_orderkey", "o_custkey")).count() == 0
    config = json.load(open(f"{tmp_path}/bins.json"))
    assert config["o_orderpriority"]["type"] == "categorical" and len(config["o_totalprice"]["values"]) == 20
    low, high = orders.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    assert made.drifted.where((F.col("o_totalprice") < low) | (F.col("o_totalprice") > high)).count() == 0
    assert files.read_delimited(spark, f"{tmp_path}/out.tbl", ", ".join(f"c{i} string" for i in range(6)), "|").count() == orders.count()
    same = pipeline.drifted_table(spark.read.parquet(f"{SF}/part.parquet"), ["p_size"], "p_partkey", 0.4, bins=10)
    assert 1 <= same.agg(F.min("p_size")).first()[0] and same.schema["p_size"].dataType.simpleString() == "int"
    with pytest.raises(ValueError):
        made.apply_drift(1.5)


def test_ladder_deletes_and_pairs(spark, numbers):
    rows = drift.ladder(numbers, "c", [0.0, 0.3], [0.5, 1.0]).collect()
    for r in rows:
        if r.d == 0:
            assert abs(r.taken - r.f * r.avail) <= 1
    p = sorted((r.avail for r in rows if r.d == 0.3 and r.f == 1.0), reverse=True)
    assert abs(drift.js(np.array(p) / 500, drift.solve(np.array(p) / 500, 0.3)[0]) - 0.3) < 1e-9
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 7)], "z long")
    for chunks in (1, 3):
        assert sorted(r.id for r in drift.delete_ids(numbers, "id", ids, chunks).collect()) == [i for i in range(500) if i % 7]
    got = {r.c: (r.pairs, r.first_better) for r in experience.pairs_by_order(numbers.where("y is not null"), "c", "id", "y").collect()}
    plain = {}
    rows = [r for r in numbers.collect() if r.y is not None]
    for a in rows:
        for b in rows:
            if a.c == b.c and a.id < b.id:
                n, w = plain.get(a.c, (0, 0))
                plain[a.c] = (n + 1, w + (a.y < b.y))
    assert got == plain
    pairs = experience.training_pairs(numbers.where("y is not null"), "c", "id", "y")
    assert pairs.count() == sum(n for n, _ in plain.values()) and pairs.where("better").count() == sum(w for _, w in plain.values())
    with pytest.raises(ValueError, match="more than 5"):
        experience.training_pairs(numbers, "c", "id", "y", 5)


def test_queries_as_text():
    sql = "SELECT a.x, f(b.y, 1) AS z FROM t1 AS a, t2 b WHERE a.id = b.id AND b.d > a.d + interval '3' day AND a.s = 'x.y = z.w' AND (a.n IN (1, 2) OR a.n IS NOT NULL) AND b.k NOT BETWEEN 1 AND 2 GROUP BY a.x"
    assert features.join_graph(sql) == [("a.id", "=", "b.id")]
    assert features.join_graph(sql, True) == [("a.d", "<", "b.d"), ("a.id", "=", "b.id")]
    assert features.adjacency(features.join_graph(sql)) == {"a": ["b"], "b": ["a"]}
    assert features.tables_of(sql) == {"a": "t1", "b": "t2"} and features.selects(sql) == ["a.x", "f(b.y, 1) AS z"]
    parts = features.conjuncts(sql)
    assert len(parts) == 5 and parts[-1] == "b.k NOT BETWEEN 1 AND 2"
    c = features.comparison(parts[3])
    assert c.op == "OR" and [p.op for p in c.parts] == ["IN", "IS NOT NULL"] and c.parts[0].values == ["1", "2"]
    assert features.comparison("a.d >= date '1994-01-01'").values == ["1994-01-01"] and features.comparison("x = '5'::int").values == ["5"]
    assert features.ddl("CREATE TABLE t (id integer NOT NULL, p decimal(15,2), n varchar(10), PRIMARY KEY (id));") == {"t": {"id": "int", "p": "float", "n": "str"}}
    assert features.query_features(["a", "b", "c"], [("a.x", "=", "c.y")], {"a": 10.0}, 100.0) == [0.0, 1.0, 0.0, 0.5, 0.0, 0.0]
    assert features.selectivity_features(["t", "u"], {"t": 50.0}, {"t": 100.0, "u": 10.0}, 2) == [1.0, 0.5, 0.0, 0.0]


def test_explained_plans(spark):
    joins = {("n_regionkey", "=", "r_regionkey"), ("c_nationkey", "=", "n_nationkey")}
    owner = lambda c: {"r": "region", "n": "nation", "c": "customer"}[c[0]]
    plan = explain._plans(spark, SF)["q_chain"]
    assert plan.tables() == ["customer", "nation", "region"] and plan.cost
    assert ("region", "r_name", "AFRICA") in explain.equality_filters(plan) and ("region", "r_name") in explain.filtered_columns(plan)
    sub = next(x for x in explain.subtrees(plan, False) if len(x.tables()) == 2)
    text = explain.to_sql(plan, joins, owner, {"region": ["r_name = 'REGION_1'"]}, "count(*) AS n")
    counts = explain.Cardinalities(spark, joins, owner)
    assert counts.of(plan) == spark.read.parquet(f"{SF}/customer.parquet").count() and counts.of(plan) == counts.known[tuple((t, ()) for t in plan.tables())]
    assert "r_name = 'REGION_1'" in text and explain.relevant_joins(sub, joins, owner)
    words = explain.vocabulary([explain.generic(plan)])
    assert words["tables"] == plan.tables() and set(words["operators"]) == {"Join", "Scan"}
    rows = explain.node_features(explain.generic(plan), words)
    assert len(rows) == 5 and explain.parent_places(plan)[0] == -1 and all(len(r) == 7 for r in rows)
    doc = json.dumps([{"Plan": {"Node Type": "Aggregate", "Total Cost": 9.5, "Plans": [{"Node Type": "Hash Join", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "t", "Plan Rows": 4}, {"Node Type": "Hash", "Plans": [{"Node Type": "Index Scan", "Relation Name": "u", "Filter": "(x = 3)"}]}]}]}}])
    tree = explain.joins_and_scans(explain.from_json(doc))
    assert explain.to_hint(tree) == "/*+ HashJoin(t u) SeqScan(t) IndexScan(u) Leading((t u)) */" and tree.cost == 9.5
    assert explain.equality_filters(tree) == [("u", "x", "3")]


def test_arms_and_searches(spark):
    assert len(arms.arms()) == 26 and arms.arms()[0] == set(arms.JOINS) | set(arms.SCANS) and len(arms.arms(arms.DEFAULT_ARMS)) == 5
    assert arms.as_sql(arms.arms()[8])[0] == "SET enable_hashjoin TO on" and arms.as_sql(arms.arms()[8])[1] == "SET enable_mergejoin TO off"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with arms.playing(spark, frozenset(("mergejoin", "seqscan"))):
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert arms.choose_arm({0: 5.0, 3: 5.0, 2: 4.0}) == 2 and arms.choose_arm({3: 5.0, 0: 5.0}) == 0
    assert arms.choose_with_fallback(500.0, {"h": 400.0}, {"h": 0.1}) == ("h", 1500.0) and arms.choose_with_fallback(50.0, {"h": 4.0}, {"h": 0.1})[0] is None
    g, _ = joinorder.tpch_graph(spark, SF)
    full, narrow = arms.left_deep(g), arms.left_deep(g, beam=1)
    assert len(full[1]) == len(g.rows) and full[0] <= narrow[0] and arms.left_deep(g, "part")[1][0] == ("part", "scan")
    assert arms.greedy_beam(g, 10)[0] == joinorder.beam(g, 10)[0] <= arms.greedy_beam(g, 2, 1.0)[0]


def test_workload_drift(spark, tmp_path):
    queries = spark.createDataFrame([("a", "SELECT * FROM t"), ("b", "SELECT 1 FROM t"), ("c", "SELECT * FROM t, u WHERE t.x = u.x"), ("d", "SELECT * FROM t WHERE x > 3")], "id string, sql string")
    w = features.WorkloadDrift("table", n_samples=400)
    pipeline.make_drift(w, queries, f"{tmp_path}/out", f"{tmp_path}/bins.json", 0.2)
    assert w.p == [0.75, 0.25] and abs(drift.js(np.array(w.p), np.array(w.q)) - 0.2) < 1e-6
    got = {r.id: r["count"] for r in w.drawn.groupBy("id").count().collect()}
    assert sum(got.values()) == 400 and abs(got["c"] / 400 - w.q[1]) < 0.08
    assert json.load(open(f"{tmp_path}/bins.json"))["map"]["table"]['["t","u"]'] == ["c"]
    assert spark.read.text(f"{tmp_path}/out").count() == 400


def test_logs_keys_and_templates(spark, tmp_path):
    (tmp_path / "run_no_geqo.txt").write_text("h, 2, t, queries/1a.sql, 1.5, 20.0, M\nh, 1, t, queries/1a.sql, 1.5, 30.0, M\nbroken\n")
    log = files.read_run_log(spark, f"file://{tmp_path}/run_no_geqo.txt")
    both = evaluation.union_logs([log, log.drop("split").withColumn("method", F.lit("N"))])
    assert [(r.method, r.run_type, r.query_ident, r.total_time) for r in both.orderBy("method").collect()] == [("M", "no_geqo", "01a", 21.5), ("N", "no_geqo", "01a", 21.5)]
    assert [r.n for r in evaluation.completeness(both).collect()] == [1, 1]
    (tmp_path / "plans.txt").write_text('q1#####[{"Plan": {}, "Execution Time": 3.5}]\nq2#####{"Execution Time": 4}\n')
    assert [(r.id, r.execution_time) for r in files.read_plan_log(spark, f"file://{tmp_path}/plans.txt").collect()] == [("q1", 3.5), ("q2", 4.0)]
    (tmp_path / "free.txt").write_text("epoch 3 loss 0.5\nnoise\n")
    assert [tuple(r) for r in files.read_pattern_log(spark, f"file://{tmp_path}/free.txt", r"epoch (\d+) loss ([\d.]+)", ["epoch", "loss"]).collect()] == [("3", "0.5")]
    (tmp_path / "t.csv").write_text('id,name\n7,"a"\n9,b\n')
    assert sorted(r.key for r in files.first_column_keys(spark, f"file://{tmp_path}/t.csv").collect()) == [7, 9]
    with pytest.raises(ValueError, match="names no key type"):
        files.key_bits("/x/uint64/keys")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_keys(spark, f"file://{tmp_path}/none_uint32")
    keys = spark.createDataFrame([(v,) for v in range(3000, 0, -1)], "k long")
    assert files.write_keys(keys, f"{tmp_path}/k_uint32") == 3000
    files.RANGE, kept = 1 << 10, files.RANGE
    try:
        back = files.read_keys(spark, f"file://{tmp_path}/k_uint32")
        assert back.rdd.getNumPartitions() > 3 and sorted(int(r.key) for r in back.collect()) == list(range(1, 3001))
    finally:
        files.RANGE = kept
    made = files.fill_templates("SELECT :a FROM t WHERE x > :ab", spark.createDataFrame([(1, 5, "y")], "id int, ab int, a string"))
    assert made.first().sql == "SELECT y FROM t WHERE x > 5"
    df = files.coerce(spark.createDataFrame([(1.0, 1.5, None), (2.0, 2.0, 3.0)], "a double, b double, c double").coalesce(1))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "double")]
    (tmp_path / "w.sql").write_text("SELECT 'a;b' AS x; -- note\nSELECT 2;\n")
    assert [(r.ordinal, r.sql) for r in files.read_sql_folder(spark, f"file://{tmp_path}/w.sql").orderBy("ordinal").collect()] == [(0, "SELECT 'a;b' AS x"), (1, "SELECT 2")]
    assert json.loads(files.workload_json(spark.createDataFrame([('q"1', "SELECT 'x'")], "id string, sql string")).first()[0]) == ["SELECT 'x'", 'q"1', [-1.0, False]]
    files.write_document({"p": np.array([0.5]), "n": np.int64(3)}, f"{tmp_path}/c.json")
    assert json.load(open(f"{tmp_path}/c.json")) == {"p": [0.5], "n": 3}


def test_aqp_text_and_frames(spark):
    table = spark.read.parquet(f"{SF}/lineitem.parquet")
    table.createOrReplaceTempView("lineitem")
    for agg, col in (("COUNT", None), ("SUM", "l_quantity"), ("AVG", "l_tax")):
        where = [("l_returnflag", "IN", ["A", "R"]), ("l_quantity", ">=", 10.0)]
        one = {r.l_linestatus: r.result for r in evaluation.aqp(table, agg, col, where, ["l_linestatus"]).collect()}
        two = {r.l_linestatus: r.result for r in spark.sql(evaluation.aqp_sql("lineitem", agg, col, where, ["l_linestatus"])).collect()}
        assert one.keys() == two.keys() and all(math.isclose(one[k], two[k]) for k in one)
