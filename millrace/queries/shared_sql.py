"""Queries whose text Spark (after the dialect's rewriting) and DuckDB both read: {name} stands for a table."""

SHARED = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty,
               round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    # scans
    "scan_columns": "SELECT o_orderkey, o_orderstatus FROM {orders}",
    "scan_all": "SELECT * FROM {nation}",
    "scan_range": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_orderkey BETWEEN 100 AND 2000",
    "multi_probe": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey IN (1, 7, 33, 100, 4000000)",
    "distinct_scan": "SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}",
    "last_key": "SELECT max(o_orderkey) AS last_key FROM {orders}",
    "values_table": "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, CAST(NULL AS VARCHAR(1)))) AS v(id, name)",
    "values_subquery": "SELECT * FROM (VALUES (1, (SELECT max(n_nationkey) FROM {nation})), (2, (SELECT n_nationkey FROM {nation} WHERE n_name = 'NOWHERE'))) AS v(id, n)",
    # projection and predicates
    "comparisons": "SELECT p_partkey FROM {part} WHERE p_size > 10 AND p_size <= 40 AND p_size <> 25 AND p_brand >= 'Brand#2' AND p_retailprice < 1500",
    "null_tests": "SELECT v.id, v.x IS NULL AS is_null, v.x IS NOT NULL AS not_null FROM (VALUES (1, 5), (2, NULL), (3, 0)) AS v(id, x)",
    "truth_tests": "SELECT v.id, (v.x > 3) IS TRUE AS t, (v.x > 3) IS NOT TRUE AS nt, (v.x > 3) IS FALSE AS f, (v.x > 3) IS NULL AS u FROM (VALUES (1, 5), (2, NULL), (3, 0)) AS v(id, x)",
    "three_valued_logic": "SELECT a.id AS a, b.id AS b, a.x AND b.x AS conj, a.x OR b.x AS disj, NOT a.x AS neg FROM (VALUES (1, TRUE), (2, FALSE), (3, NULL)) AS a(id, x) CROSS JOIN (VALUES (1, TRUE), (2, FALSE), (3, NULL)) AS b(id, x)",
    "between": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity NOT BETWEEN 5 AND 45 AND l_discount BETWEEN 0.02 AND 0.04",
    "in_list": "SELECT c_custkey FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    "in_list_mixed_types": "SELECT v.x FROM (VALUES (1.0), (1.5), (2.0)) AS v(x) WHERE v.x IN (1, 1.5, 3)",
    "like": "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a%e%' AND p_type NOT LIKE 'SMALL%'",
    "like_escape": "SELECT v.s FROM (VALUES ('10%'), ('100'), ('a_b'), ('acb')) AS v(s) WHERE v.s LIKE '%#%' ESCAPE '#' OR v.s LIKE 'a#_b' ESCAPE '#'",
    "exists": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "not_exists": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "in_subquery": "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)",
    "not_in_subquery": "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)",
    "not_in_empty": "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT r_regionkey FROM {region} WHERE r_name = 'NOWHERE')",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT 1.8 * avg(o_totalprice) FROM {orders})",
    "correlated_scalar": "SELECT p_partkey, (SELECT max(l_quantity) FROM {lineitem} l WHERE l.l_partkey = p.p_partkey) AS most FROM {part} p",
    "derived_table": "SELECT d.o_custkey, d.n FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) AS d WHERE d.n > 15",
    "constant_false": "SELECT n_name FROM {nation} WHERE 1 = 0",
    "case_expression": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS code FROM {lineitem}",
    "coalesce_nullif": "SELECT v.id, coalesce(v.x, v.y, 0) AS c, nullif(v.x, 5) AS n FROM (VALUES (1, 5, 1), (2, NULL, 7), (3, NULL, NULL)) AS v(id, x, y)",
    "cast": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(o_custkey AS INTEGER) AS i, CAST(o_orderstatus = 'F' AS INTEGER) AS b FROM {orders}",
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM {orders} o RIGHT JOIN {customer} c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM {supplier} s FULL JOIN {customer} c ON s.s_suppkey = c.c_custkey",
    "join_cross": "SELECT r.r_regionkey, n.n_nationkey FROM {region} r CROSS JOIN {nation} n",
    "join_comma": "SELECT n.n_name, r.r_name FROM {nation} n, {region} r WHERE n.n_regionkey = r.r_regionkey",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_using": "SELECT k, a.x, b.y FROM (SELECT n_regionkey AS k, n_nationkey AS x FROM {nation}) a JOIN (SELECT r_regionkey AS k, r_name AS y FROM {region}) b USING (k)",
    "join_natural": "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_nationkey AS x FROM {nation}) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS y FROM {region}) b",
    "join_self": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multiway": """
        SELECT r.r_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(*) AS n
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
        JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""",
    # aggregation
    "agg_scalar": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM {orders}",
    "agg_empty": "SELECT count(*) AS n, count(o_orderkey) AS k, sum(o_totalprice) AS total, max(o_orderkey) AS hi FROM {orders} WHERE 1 = 0",
    "agg_scalar_distinct": "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses FROM {orders}",
    "agg_grouped": "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM {orders} GROUP BY o_orderpriority",
    "agg_grouped_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS total FROM {orders} GROUP BY o_orderstatus",
    "agg_expression_key": "SELECT extract(year FROM o_orderdate) AS y, count(*) AS n FROM {orders} GROUP BY extract(year FROM o_orderdate)",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 300000",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY ROLLUP(l_returnflag, l_linestatus)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE(l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_variance": "SELECT o_orderstatus, round(var_pop(o_totalprice), 0) AS vp, round(var_samp(o_totalprice), 0) AS vs, round(stddev_pop(o_totalprice), 3) AS sp, round(stddev_samp(o_totalprice), 3) AS ss FROM {orders} GROUP BY o_orderstatus",
    "agg_var_samp_one": "SELECT var_samp(v.x) AS vs, stddev_samp(v.x) AS ss, var_pop(v.x) AS vp FROM (VALUES (1.5e0)) AS v(x)",
    "agg_min_max_strings": "SELECT c_nationkey, min(c_name) AS lo, max(c_mktsegment) AS hi FROM {customer} GROUP BY c_nationkey",
    # windows
    "window_named": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS r FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_aggregate": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM {orders}",
    # order, limit, distinct
    "order_by_nulls": "SELECT v.id FROM (VALUES (1, 5), (2, NULL), (3, 1)) AS v(id, x) ORDER BY v.x NULLS FIRST LIMIT 2",
    "order_by_nulls_high": "SELECT v.id FROM (VALUES (1, 5), (2, NULL), (3, 1)) AS v(id, x) ORDER BY v.x DESC NULLS FIRST LIMIT 1",
    "order_by_ordinal": "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY 2 DESC, 1 LIMIT 10",
    "top_k": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}",
    # set operations
    "union_all": "SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey AS k FROM {region}",
    "union_distinct": "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey AS k FROM {region}",
    "intersect": "SELECT a.x, a.y FROM (VALUES (1, 2), (5, NULL), (5, NULL), (3, 3)) AS a(x, y) INTERSECT SELECT b.x, b.y FROM (VALUES (5, NULL), (1, 2), (1, 2)) AS b(x, y)",
    "intersect_all": "SELECT a.x, a.y FROM (VALUES (1, 2), (1, 2), (5, NULL), (5, NULL)) AS a(x, y) INTERSECT ALL SELECT b.x, b.y FROM (VALUES (5, NULL), (5, NULL), (1, 2)) AS b(x, y)",
    "except": "SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey AS k FROM {supplier}",
    "except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}",
    "with_query": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey), best AS (SELECT max(t) AS t FROM big) SELECT big.o_custkey FROM big JOIN best ON big.t = best.t",
    # scalar functions
    "string_functions": "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, c_name || '/' || c_mktsegment AS both_, substring(c_name, 3, 5) AS sub, char_length(c_name) AS n FROM {customer}",
    "trim_functions": "SELECT trim(BOTH 'x' FROM v.s) AS b, trim(LEADING 'x' FROM v.s) AS l, trim(TRAILING 'x' FROM v.s) AS t, ltrim(v.p) AS lt, rtrim(v.p) AS rt FROM (VALUES ('xxaxx', '  p '), ('x', ' q')) AS v(s, p)",
    "extract_functions": "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d, extract(hour FROM o_orderdate) AS h, extract(minute FROM o_orderdate) AS mi FROM {orders}",
    "math_functions": "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS sq, round(ln(p_retailprice), 6) AS ln_, round(log10(p_retailprice), 6) AS lg, round(exp(p_size / 100.0e0), 6) AS ex, ceil(p_retailprice) AS ce, floor(p_retailprice) AS fl, sign(p_size - 25) AS sg, abs(p_size - 25) AS ab, mod(p_size, 7) AS md FROM {part}",
    "trig_functions": "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(atan(p_size), 9) AS at_, round(atan2(p_size, 2), 9) AS at2, round(acos(p_size / 100.0e0), 9) AS ac, round(asin(p_size / 100.0e0), 9) AS as_, round(degrees(p_size), 6) AS de, round(radians(p_size), 9) AS ra, round(pi(), 9) AS p FROM {part}",
    "unary_minus": "SELECT p_partkey, -p_size AS neg, +p_size AS pos FROM {part}",
}
