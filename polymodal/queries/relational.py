"""Scans, joins, aggregates, windows, sets, subqueries, recursion, changes and the pricing and order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, constraints, dml, joins, recursive, sequences, sorting
from ._case import case, engine

CASES: dict = {}


def _c(name, text, oracle=None):
    case(CASES, name, text, oracle)


# ------------------------------------------------------- decision-support queries

_c("tpch_q1", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
_c("tpch_q3", """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
    AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
_c("tpch_q4", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY o_orderpriority ORDER BY o_orderpriority")
_c("tpch_q5", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
    AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name ORDER BY revenue DESC, n_name""")
_c("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
_c("tpch_q7", """SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM supplier, lineitem, orders, customer, nation n1, nation n2
    WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_nationkey <> n2.n_nationkey GROUP BY 1, 2, 3 ORDER BY 1, 2, 3""")
_c("tpch_q9", """SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_profit FROM part, supplier, lineitem, orders, nation
    WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_size > 10 GROUP BY 1, 2 ORDER BY 1, 2 DESC""")
_c("tpch_q10", """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
_c("tpch_q12", """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linestatus = 'F' GROUP BY l_returnflag ORDER BY l_returnflag""")
_c("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders GROUP BY c_count ORDER BY custdist DESC, c_count DESC")
_c("tpch_q14", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey")
_c("tpch_q15", """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM lineitem GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""")
_c("tpch_q17", "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 20 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)")
_c("tpch_q18", """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)
    AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
_c("tpch_q19", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 6 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 11 AND 15 AND l_quantity BETWEEN 20 AND 30))")
_c("tpch_q21", """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
    AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")
_c("tpch_q22", "SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey ORDER BY c_nationkey")

# --------------------------------------------------------------------- scans

_c("scan_filter_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount > 0.02")
_c("scan_in_null", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice IS NOT NULL")
_c("scan_index_or", "SELECT p_partkey FROM part WHERE p_size = 5 OR p_brand = 'Brand#12' OR p_partkey < 10")
_c("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS v(id, name)")
_c("one_row_select", "SELECT 1 + 2 AS three, 'x' || 'y' AS xy, NULL IS NULL AS is_null")
_c("generate_series_from", "SELECT g.x, g.x * g.x AS sq FROM generate_series(1, 20) AS g(x)")
_c("unnest_from", "SELECT u.x FROM unnest(ARRAY[3, 1, 2]) AS u(x)")
_c("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 LIMIT 7")
_c("fetch_first", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey FETCH FIRST 5 ROWS ONLY")
_c("information_schema", "SELECT column_name FROM information_schema.columns WHERE table_name = 'orders'", "SELECT column_name FROM information_schema.columns WHERE table_name = 'orders'")


def copy_round_trip(spark, sf_dir):
    from .. import sources
    from ..operators.recursive import cut

    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    cut(df.limit(1))  # makes sure of a shared folder
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    import uuid

    path = f"{top}/copy-{uuid.uuid4().hex}"
    sources.copy_to(df, path)
    return sources.copy_from(spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double")


CASES["copy_round_trip"] = (copy_round_trip, "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")

# --------------------------------------------------------------- predicates

_c("predicates_distinct_from", "SELECT o_orderkey, o_orderstatus IS DISTINCT FROM 'F' AS d, o_orderstatus IS NOT DISTINCT FROM 'F' AS s FROM orders")
_c("predicates_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type ILIKE 'standard%' OR p_brand NOT LIKE 'Brand#1%'")
_c("predicates_regex", "SELECT p_partkey, p_brand ~ '#[12]' AS a, p_brand ~* 'BRAND' AS b, p_brand !~ '3$' AS c FROM part", "SELECT p_partkey, regexp_matches(p_brand, '#[12]') AS a, regexp_matches(p_brand, 'BRAND', 'i') AS b, NOT regexp_matches(p_brand, '3$') AS c FROM part")
_c("predicates_similar", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)_'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).')")
_c("predicates_symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN SYMMETRIC 20 AND 10", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
_c("predicates_any_array", "SELECT n_nationkey FROM nation WHERE n_regionkey = ANY(ARRAY[1, 3])")
_c("predicates_all_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3)", "SELECT c_custkey FROM customer WHERE c_acctbal >= (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = 3)")
_c("predicates_overlaps", "SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderdate + INTERVAL '30 days') OVERLAPS (DATE '1995-01-01', DATE '1995-02-01')", "SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1995-02-01' AND DATE '1995-01-01' < o_orderdate + INTERVAL 30 DAY")
_c("predicates_three_valued", "SELECT (NULL AND false) AS a, (NULL OR true) AS b, (NULL = NULL) AS c, (1 IN (2, NULL)) AS d, (NOT NULL) IS NULL AS e")
_c("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done, nullif(o_orderstatus, 'O') AS n, coalesce(nullif(o_orderstatus, 'P'), '?') AS c FROM orders")
_c("casts", "SELECT l_orderkey, l_linenumber, l_quantity::int AS q, (l_extendedprice::numeric(20,2))::text AS t, l_shipdate::date AS d, l_orderkey::text || '-' || l_linenumber::text AS k FROM lineitem")
_c("integer_division", "SELECT l_orderkey, l_linenumber, div(l_orderkey, 7) AS q, l_orderkey % 7 AS r, -l_linenumber AS n FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, l_orderkey % 7 AS r, -l_linenumber AS n FROM lineitem")

# -------------------------------------------------------------------- joins

_c("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000")
_c("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
_c("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal")
_c("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
_c("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_c("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_regionkey < r_regionkey")
_c("join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey = b.s_nationkey")
_c("join_using", "SELECT n_regionkey, x.n, y.m FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) x JOIN (SELECT n_regionkey, max(n_name) AS m FROM nation GROUP BY n_regionkey) y USING (n_regionkey)")
_c("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y")
_c("join_lateral", "SELECT n_name, t.c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t")
_c("join_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
_c("join_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, (SELECT min(s_nationkey) FROM supplier)) FROM supplier)")
CASES["join_not_in_frame"] = (lambda s, d: joins.not_in(s.read.parquet(f"{d}/nation.parquet"), s.read.parquet(f"{d}/supplier.parquet"), "n_nationkey", "s_nationkey"), "SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")


def join_asof(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    return joins.asof(left, right, ["user_id"], "ts", values=["click_id"])


CASES["join_asof"] = (join_asof, """WITH r AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL)
    SELECT l.user_id, l.ts, l.event_id, r.click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")


def join_interval(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice")
    b = spark.range(0, 40).select((F.col("id") * 50.0).alias("lo"), (F.col("id") * 50.0 + 75).alias("hi"))
    return joins.interval_join(p, b, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "lo", "hi")


CASES["join_interval"] = (join_interval, "SELECT p_partkey, lo, hi FROM part, (SELECT i * 50.0::DOUBLE AS lo, i * 50.0::DOUBLE + 75 AS hi FROM range(40) r(i)) b WHERE p_retailprice >= lo AND p_retailprice < hi")
CASES["join_salted"] = (lambda s, d: joins.salted_join(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k")), s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("k"), "s_name"), ["k"]), "SELECT l_orderkey, l_linenumber, l_suppkey AS k, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")

# --------------------------------------------------------------- aggregation

_c("agg_basic", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS d, min(l_shipdate) AS lo, max(l_shipdate) AS hi, bool_and(l_quantity > 0) AS ba, bool_or(l_quantity > 49) AS bo FROM lineitem GROUP BY l_returnflag")
_c("agg_statistics", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 5) AS vp, round(var_samp(l_quantity), 5) AS vs FROM lineitem GROUP BY l_returnflag")
_c("agg_regression", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 5) AS ax FROM lineitem GROUP BY l_returnflag")
_c("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 2) AS s FROM orders GROUP BY o_orderpriority")
_c("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_c("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
_c("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_c("agg_cube", "SELECT o_orderstatus, o_orderpriority, round(max(o_totalprice), 2) AS m FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_c("agg_string_agg", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
_c("agg_array_agg", "SELECT n_regionkey, array_to_string(array_agg(n_nationkey ORDER BY n_name DESC), ',') AS keys FROM nation GROUP BY n_regionkey")
_c("agg_array_nulls", "SELECT n_regionkey, array_length(array_agg(nullif(n_nationkey, 3) ORDER BY n_nationkey), 1) AS n FROM nation GROUP BY n_regionkey")
_c("agg_percentiles", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS med, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q1 FROM lineitem GROUP BY l_returnflag")
_c("agg_bits", "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey")
_c("agg_empty_input", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_shipdate) AS m, array_agg(l_orderkey) IS NULL AS a FROM lineitem WHERE l_quantity < 0")
_c("agg_expression_keys", "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY date_trunc('month', o_orderdate)", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n FROM orders GROUP BY 1")
_c("agg_distinct_sum", "SELECT o_orderstatus, sum(DISTINCT CAST(floor(o_totalprice) AS BIGINT)) % 1000003 AS s, count(DISTINCT o_custkey) AS c FROM orders GROUP BY o_orderstatus")


def agg_hypothetical(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    x, v = F.col("c_acctbal"), F.lit(1000.0)
    return c.groupBy("c_nationkey").agg(aggregates.hypothetical_rank(x, v).alias("r"), aggregates.hypothetical_dense_rank(x, v).alias("dr"), aggregates.hypothetical_percent_rank(x, v).alias("pr"), aggregates.hypothetical_cume_dist(x, v).alias("cd"))


CASES["agg_hypothetical"] = (agg_hypothetical, "SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal < 1000) + 1 AS r, count(DISTINCT c_acctbal) FILTER (WHERE c_acctbal < 1000) + 1 AS dr, (count(*) FILTER (WHERE c_acctbal < 1000))::DOUBLE / count(*) AS pr, (count(*) FILTER (WHERE c_acctbal <= 1000) + 1)::DOUBLE / (count(*) + 1) AS cd FROM customer GROUP BY c_nationkey")
CASES["agg_skewed_sum"] = (lambda s, d: aggregates.skewed_sum(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_linenumber"), ["l_returnflag"], "l_linenumber"), "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS l_linenumber FROM lineitem GROUP BY l_returnflag")

# -------------------------------------------------------------------- windows

_c("window_ranks", "SELECT o_orderkey, row_number() OVER w AS rn, CAST(rank() OVER p AS BIGINT) AS r, CAST(dense_rank() OVER p AS BIGINT) AS dr, round(percent_rank() OVER p, 8) AS pr, round(cume_dist() OVER p, 8) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey), p AS (PARTITION BY o_orderpriority ORDER BY o_orderstatus)")
_c("window_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q FROM customer")
_c("window_lag_lead", "SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders")
_c("window_values", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_c("window_running", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 2) AS s, count(*) OVER (PARTITION BY l_orderkey) AS n, round(avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS a, min(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS lo FROM lineitem")
_c("window_peers", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS n FROM orders")
_c("window_frames", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM lineitem")
_c("window_variance", "SELECT o_orderkey, round(stddev_pop(o_totalprice) OVER (PARTITION BY o_custkey), 3) AS sp, round(var_samp(o_totalprice) OVER (PARTITION BY o_custkey), 1) AS vs FROM orders")
_c("window_over_aggregate", "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS r FROM orders GROUP BY o_custkey")

# --------------------------------------------------------------- order, distinct

_c("order_nulls", "SELECT k FROM (SELECT nullif(n_nationkey, 5) AS k FROM nation) t ORDER BY k DESC LIMIT 3", "SELECT k FROM (SELECT nullif(n_nationkey, 5) AS k FROM nation) t ORDER BY k DESC NULLS FIRST LIMIT 3")
_c("order_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
_c("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_c("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
CASES["distinct_on_frame"] = (lambda s, d: sorting.distinct_on(s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], sorting.desc("o_orderdate"), sorting.asc("o_orderkey")), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
CASES["top_k_per_group"] = (lambda s, d: sorting.top_k_per_group(s.read.parquet(f"{d}/customer.parquet").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 3, sorting.desc("c_acctbal"), sorting.asc("c_custkey")), "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")

# --------------------------------------------------------- sets, CTEs, subqueries

_c("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_c("set_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
_c("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_c("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_c("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
_c("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
_c("cte_columns", "WITH t(a, b) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey), u AS (SELECT max(b) AS m FROM t) SELECT t.a, t.b, u.m FROM t, u")
_c("cte_recursive_all", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")
_c("cte_recursive_union", "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, (n_nationkey * 2 + 1) % 25 FROM nation UNION SELECT r.a, (r.b * 2 + 1) % 25 FROM r) SELECT a, b FROM r")
CASES["transitive_closure"] = (lambda s, d: recursive.transitive_closure(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 3 + 2) % 25).cast("long").alias("dst"))), "WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey * 3 + 2) % 25)::BIGINT AS dst FROM nation), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT * FROM c")
_c("subquery_scalar", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
_c("subquery_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
_c("subquery_array", "SELECT r_regionkey, cardinality(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey)) AS n FROM region", "SELECT r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
_c("subquery_any", "SELECT s_suppkey FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = s_nationkey)")
_c("derived_tables", "SELECT t.p, u.n FROM (SELECT o_orderpriority AS p, max(o_totalprice) AS m FROM orders GROUP BY o_orderpriority) t JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY o_orderpriority) u ON t.p = u.p")

# ------------------------------------------------------------------ statements


def _changed(table: str, *statements: str):
    def run(spark, sf_dir):
        e = engine(spark, sf_dir, " ".join(statements) + " " + table)
        for s in statements:
            e.sql(s)
        return e.table(table)

    return run


_R = "SELECT r_regionkey, r_name FROM region"
CASES["dml_insert_values"] = (_changed("region", "INSERT INTO region (r_regionkey, r_name) VALUES (90, 'NEW'), (91, NULL)"), f"{_R} UNION ALL VALUES (90, 'NEW'), (91, NULL)")
CASES["dml_insert_select"] = (_changed("region", "INSERT INTO region SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1"), f"{_R} UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
CASES["dml_conflict_nothing"] = (_changed("region", "INSERT INTO region VALUES (1, 'X'), (7, 'SEVEN') ON CONFLICT (r_regionkey) DO NOTHING"), f"{_R} UNION ALL VALUES (7, 'SEVEN')")
CASES["dml_conflict_update"] = (_changed("region", "INSERT INTO region VALUES (1, 'X'), (7, 'SEVEN') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = excluded.r_name || region.r_name"), "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'X' || r_name ELSE r_name END AS r_name FROM region UNION ALL VALUES (7, 'SEVEN')")
CASES["dml_update"] = (_changed("customer", "UPDATE customer SET c_acctbal = c_acctbal + 1, c_mktsegment = 'M' WHERE c_nationkey = 3"), "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'M' ELSE c_mktsegment END AS c_mktsegment FROM customer")
CASES["dml_update_from"] = (_changed("nation", "UPDATE nation SET n_name = n_name || '/' || region.r_name FROM region WHERE nation.n_regionkey = region.r_regionkey AND region.r_regionkey < 2"), "SELECT n_nationkey, CASE WHEN r_regionkey < 2 THEN n_name || '/' || r_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
CASES["dml_delete"] = (_changed("orders", "DELETE FROM orders WHERE o_totalprice < 100000 OR o_orderstatus = 'P'"), "SELECT * FROM orders WHERE NOT (o_totalprice < 100000 OR o_orderstatus = 'P')")
CASES["dml_delete_using"] = (_changed("nation", "DELETE FROM nation USING region WHERE nation.n_regionkey = region.r_regionkey AND region.r_name = 'ASIA'"), "SELECT * FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
CASES["dml_merge"] = (_changed("region", "MERGE INTO region t USING (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 8) s ON t.r_regionkey = s.k WHEN MATCHED AND s.k = 2 THEN DELETE WHEN MATCHED THEN UPDATE SET r_name = s.v WHEN NOT MATCHED AND s.k = 6 THEN DO NOTHING WHEN NOT MATCHED THEN INSERT (r_regionkey, r_name) VALUES (s.k, lower(s.v))"),
    "SELECT r_regionkey, coalesce(n_name, r_name) AS r_name FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 8) ON r_regionkey = n_nationkey WHERE r_regionkey <> 2 UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_nationkey < 8 AND n_nationkey NOT IN (SELECT r_regionkey FROM region) AND n_nationkey <> 6")
CASES["ddl_ctas"] = (_changed("big", "CREATE TABLE big AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
CASES["ddl_select_into"] = (_changed("few", "SELECT r_regionkey INTO few FROM region WHERE r_regionkey > 1"), "SELECT r_regionkey FROM region WHERE r_regionkey > 1")
CASES["ddl_view"] = (_changed("v", "CREATE VIEW v AS SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey"), "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
CASES["ddl_truncate"] = (_changed("region", "TRUNCATE region"), "SELECT * FROM region WHERE false")
CASES["dml_update_where_frame"] = (lambda s, d: dml.update(s.read.parquet(f"{d}/part.parquet"), {"p_size": "p_size * 2"}, "p_size > 40").select("p_partkey", "p_size"), "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size * 2 ELSE p_size END AS p_size FROM part")
CASES["constraint_unique"] = (lambda s, d: constraints.unique_violations(s.read.parquet(f"{d}/orders.parquet"), ["o_custkey", "o_orderpriority"]), "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
CASES["constraint_foreign_key"] = (lambda s, d: constraints.foreign_key_violations(s.read.parquet(f"{d}/nation.parquet"), "n_nationkey", s.read.parquet(f"{d}/supplier.parquet"), "s_nationkey"), "SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
CASES["constraint_check"] = (lambda s, d: constraints.check_violations(s.read.parquet(f"{d}/customer.parquet"), "c_acctbal >= 0"), "SELECT * FROM customer WHERE NOT c_acctbal >= 0")
CASES["sequence_numbers"] = (lambda s, d: sequences.Sequence(10, 5).number(s.read.parquet(f"{d}/customer.parquet").select("c_custkey"), "n", "c_custkey"), "SELECT c_custkey, 10 + 5 * (row_number() OVER (ORDER BY c_custkey) - 1) AS n FROM customer")


def sql_function(spark, d):
    e = engine(spark, d, "lineitem")
    e.function("net_price", "p DOUBLE, disc DOUBLE", "DOUBLE", "p * (1 - disc)")
    return e.sql("SELECT l_orderkey, l_linenumber, round(net_price(l_extendedprice, l_discount), 4) AS net FROM lineitem")


CASES["sql_function"] = (sql_function, "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")

# -------------------------------------------------------------- event windows

from .. import streaming  # noqa: E402

_EV = lambda s, d: s.read.parquet(f"{d}/events.parquet")
CASES["window_tumbling"] = (lambda s, d: streaming.tumbling(_EV(s, d), "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
CASES["window_sliding"] = (lambda s, d: streaming.sliding(_EV(s, d), "ts", "2 hours", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n")), "SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w, event_type FROM events) GROUP BY ALL")
CASES["window_session"] = (lambda s, d: streaming.sessions(_EV(s, d), "ts", "6 hours", ["user_id"], F.count(F.lit(1)).alias("n")), """WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS f FROM events),
    b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM b GROUP BY user_id, g""")


def _script(last: str, *texts: str):
    """Statements in a row, of which those that must fail are marked by a first "!"; the last one's rows."""

    def run(spark, sf_dir):
        e = engine(spark, sf_dir, " ".join((*texts, last)))
        for t in texts:
            try:
                e.sql(t.removeprefix("!"))
            except ValueError:
                if not t.startswith("!"):
                    raise
            else:
                if t.startswith("!"):
                    raise AssertionError(f"should fail: {t}")
        return e.sql(last)

    return run


_c("typed_division", "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS q, (l_partkey / 3) / 2 AS h, -l_suppkey / 4 AS n, l_quantity / 2 AS x FROM lineitem WHERE l_orderkey / 2 > 10", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, (l_partkey // 3) // 2 AS h, CAST(trunc(-l_suppkey / 4.0) AS BIGINT) AS n, l_quantity / 2 AS x FROM lineitem WHERE l_orderkey // 2 > 10")
_c("typed_casts", "SELECT l_orderkey, l_linenumber, l_extendedprice::int AS f, (l_extendedprice::numeric(20, 2))::bigint AS d, CAST(-l_extendedprice::numeric(20, 1) AS int) AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice, 0) AS INT) AS f, CAST(round(l_extendedprice::DECIMAL(20, 2), 0) AS BIGINT) AS d, CAST(round(-l_extendedprice::DECIMAL(20, 1), 0) AS INT) AS m FROM lineitem")
_c("typed_dates", "SELECT o_orderkey, o_orderdate::date - DATE '1995-01-01' AS days, (o_orderdate::date - DATE '1995-01-01') / 7 AS weeks FROM orders", "SELECT o_orderkey, o_orderdate::DATE - DATE '1995-01-01' AS days, CAST(trunc((o_orderdate::DATE - DATE '1995-01-01') / 7.0) AS BIGINT) AS weeks FROM orders")
_c("typed_array_append", "SELECT n_nationkey, array_to_string(ARRAY[n_nationkey, 1] || n_regionkey, ',') AS a, array_to_string(n_regionkey || ARRAY[n_nationkey, 1], ',') AS p, array_to_string(ARRAY[n_nationkey] || ARRAY[n_regionkey], ',') AS c FROM nation", "SELECT n_nationkey, n_nationkey || ',1,' || n_regionkey AS a, n_regionkey || ',' || n_nationkey || ',1' AS p, n_nationkey || ',' || n_regionkey AS c FROM nation")
CASES["typed_sequence_rows"] = (_script("SELECT count(*) AS n, count(DISTINCT no) AS d, min(no) AS lo, max(no) AS hi FROM numbered", "CREATE SEQUENCE sq START 5 INCREMENT 2", "CREATE TABLE numbered AS SELECT c_custkey, nextval('sq') AS no FROM customer"), "SELECT count(*) AS n, count(*) AS d, 5 AS lo, 5 + 2 * (count(*) - 1) AS hi FROM customer")
CASES["transaction_rollback"] = (_script("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey", "BEGIN", "DELETE FROM nation WHERE n_regionkey = 1", "SAVEPOINT a", "DELETE FROM nation", "ROLLBACK TO a", "COMMIT", "BEGIN", "UPDATE nation SET n_regionkey = 9", "ROLLBACK"), "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey <> 1 GROUP BY n_regionkey")
CASES["constraint_enforced"] = (
    _script(
        "SELECT k, v, s, r FROM kept", "CREATE TABLE kept (k int PRIMARY KEY, v int CHECK (v >= 0), s text NOT NULL DEFAULT 'none', r int REFERENCES region (r_regionkey), UNIQUE (v, s))",
        "INSERT INTO kept SELECT n_nationkey, n_nationkey * 2, n_name, n_regionkey FROM nation", "!INSERT INTO kept VALUES (1, 100, 'x', 1)", "!INSERT INTO kept VALUES (100, -1, 'x', 1)", "!INSERT INTO kept VALUES (100, 1, NULL, 1)",
        "!INSERT INTO kept VALUES (100, 1, 'x', 77)", "INSERT INTO kept (k, v) VALUES (100, 1)", "!INSERT INTO kept (k, v) VALUES (101, 1)", "!UPDATE kept SET v = v - 3", "!DELETE FROM region WHERE r_regionkey = 2", "!ALTER TABLE kept ADD CONSTRAINT odd CHECK (k < 50)",
    ),
    "SELECT n_nationkey AS k, n_nationkey * 2 AS v, n_name AS s, n_regionkey AS r FROM nation UNION ALL SELECT 100, 1, 'none', NULL",
)
