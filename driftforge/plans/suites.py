"""The relational surface: TPC-H-, JOB- and STACK-like queries on the supplied tables, one SQL text for both engines."""

from __future__ import annotations

from driftforge.functions.twin import Twins

T = Twins()
_REV = "CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DECIMAL(28, 4))"
T.both("tpch_q01", f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS sum_base_price, {_REV} AS sum_disc_price, CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18, 6))) AS DECIMAL(28, 6)) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= timestamp '2001-09-02' - interval '90' day GROUP BY 1, 2 ORDER BY 1, 2")
T.both("tpch_q03", f"SELECT l_orderkey, {_REV} AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < timestamp '1998-03-15' AND l_shipdate > timestamp '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10")
T.both("tpch_q04", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= timestamp '1997-07-01' AND o_orderdate < timestamp '1997-07-01' + interval '3' month AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND o_orderdate < l_shipdate) GROUP BY o_orderpriority")
T.both("tpch_q05", f"SELECT n_name, {_REV} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND o_orderdate >= timestamp '1996-01-01' AND o_orderdate < timestamp '1998-01-01' GROUP BY n_name")
T.both("tpch_q06", "SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS revenue FROM lineitem WHERE l_shipdate >= timestamp '1996-01-01' AND l_shipdate < timestamp '1997-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
T.both("tpch_q07", f"SELECT supp_nation, cust_nation, l_year, {_REV.replace('l_extendedprice * (1 - l_discount)', 'volume')} AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, extract(year FROM l_shipdate) AS l_year, l_extendedprice * (1 - l_discount) AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))) s GROUP BY supp_nation, cust_nation, l_year".replace("extract(year FROM l_shipdate)", "CAST(extract(year FROM l_shipdate) AS INT)") + " ORDER BY supp_nation, cust_nation, l_year")
T.both("tpch_q08", "SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 8) AS mkt_share FROM (SELECT CAST(extract(year FROM o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND s_nationkey = n2.n_nationkey AND p_size < 20) a GROUP BY o_year" + " ORDER BY o_year")
T.both("tpch_q09", f"SELECT n_name, CAST(extract(year FROM o_orderdate) AS INT) AS o_year, {_REV} AS profit FROM part, supplier, lineitem, orders, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_type LIKE '%A%' GROUP BY n_name, CAST(extract(year FROM o_orderdate) AS INT)" + " ORDER BY n_name, o_year DESC")
T.both("tpch_q10", f"SELECT c_custkey, c_name, {_REV} AS revenue, c_acctbal FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal ORDER BY revenue DESC, c_custkey LIMIT 20")
T.both("tpch_q11", "SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem, supplier WHERE l_suppkey = s_suppkey GROUP BY l_partkey HAVING sum(l_quantity) > (SELECT sum(l_quantity) * 0.0008 FROM lineitem)")
T.both("tpch_q12", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1e0 ELSE 0e0 END) AS high_line, sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1e0 ELSE 0e0 END) AS low_line FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= timestamp '1997-01-01' GROUP BY l_linestatus" + " ORDER BY l_linestatus")
T.both("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) AS c_orders (c_custkey, c_count) GROUP BY c_count" + " ORDER BY custdist DESC, c_count DESC")
T.both("tpch_q14", "SELECT round(100.00e0 * sum(CASE WHEN p_type LIKE 'P%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem, part WHERE l_partkey = p_partkey")
T.both("tpch_q15", f"WITH revenue AS (SELECT l_suppkey AS supplier_no, {_REV} AS total_revenue FROM lineitem WHERE l_shipdate >= timestamp '1996-01-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)")
T.both("tpch_q16", "SELECT p_brand, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#1' AND p_size IN (1, 4, 9, 14, 23, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_size")
T.both("tpch_q17", "SELECT round(sum(l_extendedprice) / 7.0e0, 4) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)")
T.both("tpch_q18", "SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice")
T.both("tpch_q19", f"SELECT {_REV} AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_partkey = l_partkey AND p_brand = 'Brand#4' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)")
T.both("tpch_q20", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY l_suppkey HAVING sum(l_quantity) > (SELECT avg(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY l_suppkey) x))")
T.both("tpch_q21", "SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate) GROUP BY s_name")
T.both("tpch_q22", "SELECT c_nationkey, count(*) AS numcust, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey")
T.both("tpch_q02", "SELECT p_partkey, s_suppkey, l_extendedprice FROM part, lineitem, supplier WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_size = 15 AND l_extendedprice = (SELECT min(l_extendedprice) FROM lineitem WHERE l_partkey = p_partkey) ORDER BY l_extendedprice, p_partkey, s_suppkey LIMIT 100")
T.both("job_min_star", "SELECT min(n.n_name) AS nation, min(p.p_name) AS part, min(s.s_name) AS supp, count(*) AS n FROM region r, nation n, supplier s, lineitem l, part p, orders o WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = s.s_nationkey AND s.s_suppkey = l.l_suppkey AND l.l_partkey = p.p_partkey AND o.o_orderkey = l.l_orderkey AND p.p_brand IN ('Brand#1', 'Brand#3') AND o.o_orderpriority LIKE '1%' AND p.p_type IS NOT NULL AND n.n_name > 'NATION_1'")
T.both("job_chain_9", "SELECT min(c.c_name) AS cust, min(o.o_orderdate) AS first_date, count(*) AS n FROM region r1, nation n1, customer c, orders o, lineitem l, supplier s, nation n2, region r2, part p WHERE r1.r_regionkey = n1.n_regionkey AND n1.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey AND s.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND l.l_partkey = p.p_partkey AND r1.r_regionkey <> r2.r_regionkey AND p.p_size BETWEEN 5 AND 9")
T.both("job_ext_group", "SELECT n_name, count(DISTINCT c_custkey) AS customers, count(*) AS n FROM nation, customer, orders WHERE n_nationkey = c_nationkey AND c_custkey = o_custkey AND lower(o_orderpriority) LIKE '%high%' GROUP BY n_name ORDER BY count(*) DESC, n_name LIMIT 10")
T.both("stack_range_join", "SELECT a.event_type, count(*) AS n, count(DISTINCT a.user_id) AS users FROM events a, events b WHERE a.user_id = b.user_id AND b.ts > a.ts + interval '1' hour AND b.ts <= a.ts + interval '5' hour GROUP BY a.event_type")
T.both("stack_composite_join", "SELECT count(*) AS n FROM events a, events b WHERE a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id")
T.both("distinct_project", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
T.both("regex_filter", "SELECT p_brand, count(*) AS n FROM part WHERE p_name RLIKE '[a-z]+.*[0-9a-z]' GROUP BY p_brand", "SELECT p_brand, count(*) AS n FROM part WHERE regexp_matches(p_name, '[a-z]+.*[0-9a-z]') GROUP BY p_brand")
T.both("ilike_filter", "SELECT count(*) AS n FROM part WHERE p_type ILIKE '%a%' AND p_name NOT LIKE '%9%'")
T.both("string_compare", "SELECT count(*) AS n FROM orders WHERE o_orderpriority > '2' AND o_orderpriority <= '4'")
T.both("cast_decode", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS st, count(*) AS n FROM orders WHERE CAST(o_totalprice AS INT) % 2 = 0 OR o_totalprice > 0 GROUP BY 1", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS st, count(*) AS n FROM orders GROUP BY 1")
T.both("json_field", "SELECT event_type, CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY 1", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY 1")
T.both("substring_from", "SELECT substring(p_brand FROM 1 FOR 5) AS pre, count(*) AS n FROM part GROUP BY 1")
T.both("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
T.both("scalar_having", "SELECT c_nationkey, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY 1 HAVING avg(c_acctbal) > (SELECT avg(c_acctbal) FROM customer)")
T.both("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
T.both("anti_join", "SELECT count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
T.both("union_sets", "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 INTERSECT SELECT c_nationkey FROM customer)")
T.both("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, count(n_nationkey) AS nations FROM t LEFT JOIN nation ON n_nationkey < n GROUP BY n")
QUERIES, ORACLES = T.queries, T.oracles
