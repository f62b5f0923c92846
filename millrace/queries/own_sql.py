"""Queries in the engine's dialect, or through its operators, each with the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import call, create_procedure, create_sequence, register_function, run_sql, table
from ..database import Database
from ..functions import aggregates, scalar
from ..operators import dml, relational
from ..sources import files, search
from ..streaming import windows

#: (Spark text in the dialect, DuckDB text)
DIALECT = {
    "fetch_first": ("SELECT o_orderkey FROM {orders} ORDER BY o_orderkey FETCH FIRST 7 ROWS ONLY", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 7"),
    "offset_fetch": ("SELECT o_orderkey FROM {orders} ORDER BY o_orderkey OFFSET 5 ROWS FETCH NEXT 4 ROWS ONLY", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 4 OFFSET 5"),
    "default_null_order": ("SELECT v.id FROM (VALUES (1, 5), (2, NULL), (3, 1)) AS v(id, x) ORDER BY v.x FETCH FIRST 2 ROWS ONLY", "SELECT v.id FROM (VALUES (1, 5), (2, NULL), (3, 1)) AS v(id, x) ORDER BY v.x NULLS LAST LIMIT 2"),
    "default_null_order_desc": ("SELECT v.id FROM (VALUES (1, 5), (2, NULL), (3, 1)) AS v(id, x) ORDER BY v.x DESC FETCH FIRST ROW ONLY", "SELECT v.id FROM (VALUES (1, 5), (2, NULL), (3, 1)) AS v(id, x) ORDER BY v.x DESC NULLS FIRST LIMIT 1"),
    "jdbc_escapes": ("SELECT c_custkey, {fn concat(c_name, 'x')} AS c, {fn locate('#', c_name)} AS l, {fn abs(c_nationkey - 10)} AS a, {fn ucase(c_mktsegment)} AS u, {fn length(c_name)} AS n FROM {customer}", "SELECT c_custkey, concat(c_name, 'x') AS c, CAST(strpos(c_name, '#') AS INTEGER) AS l, abs(c_nationkey - 10) AS a, upper(c_mktsegment) AS u, CAST(length(c_name) AS INTEGER) AS n FROM {customer}"),
    "date_escapes": ("SELECT o_orderkey FROM {orders} WHERE o_orderdate >= {ts '1996-01-01 00:00:00'} AND CAST(o_orderdate AS DATE) < {d '1996-03-01'}", "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND CAST(o_orderdate AS DATE) < DATE '1996-03-01'"),
    "timestampadd": ("SELECT o_orderkey, date_format({fn timestampadd(SQL_TSI_MONTH, 1, o_orderdate)}, 'yyyy-MM-dd HH:mm:ss') AS m, date_format({fn timestampadd(SQL_TSI_DAY, -3, o_orderdate)}, 'yyyy-MM-dd HH:mm:ss') AS d, date_format({fn timestampadd(SQL_TSI_QUARTER, 2, o_orderdate)}, 'yyyy-MM-dd HH:mm:ss') AS q FROM {orders}", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS m, strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') AS d, strftime(o_orderdate + INTERVAL 6 MONTH, '%Y-%m-%d %H:%M:%S') AS q FROM {orders}"),
    "timestampdiff": ("SELECT o_orderkey, {fn timestampdiff(SQL_TSI_DAY, o_orderdate, {ts '2000-01-01 00:00:00'})} AS days, {fn timestampdiff(SQL_TSI_HOUR, o_orderdate, {ts '2000-01-01 00:00:00'})} AS hours FROM {orders}", "SELECT o_orderkey, datesub('day', o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS days, datesub('hour', o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS hours FROM {orders}"),
    "value_function": ("SELECT v.id, VALUE(v.x, 9) AS x, SUBSTR(v.s, 2) AS s, LCASE(v.s) AS l, ABSVAL(v.x) AS a FROM (VALUES (1, -5, 'Abc'), (2, NULL, 'Zz')) AS v(id, x, s)", "SELECT v.id, coalesce(v.x, 9) AS x, substring(v.s, 2) AS s, lower(v.s) AS l, abs(v.x) AS a FROM (VALUES (1, -5, 'Abc'), (2, NULL, 'Zz')) AS v(id, x, s)"),
    "hyperbolic_functions": ("SELECT p_partkey, round(sinh(p_size / 50.0D), 9) AS sh, round(cosh(p_size / 50.0D), 9) AS ch, round(tanh(p_size / 50.0D), 9) AS th, round(cot(p_size), 6) AS ct FROM {part}", "SELECT p_partkey, round((exp(p_size / 50.0e0) - exp(-p_size / 50.0e0)) / 2, 9) AS sh, round((exp(p_size / 50.0e0) + exp(-p_size / 50.0e0)) / 2, 9) AS ch, round((exp(p_size / 25.0e0) - 1) / (exp(p_size / 25.0e0) + 1), 9) AS th, round(1 / tan(p_size), 6) AS ct FROM {part}"),
    "session_values": ("SELECT CURRENT ISOLATION AS iso, CURRENT_DATE = CURRENT_DATE AS stable", "SELECT 'CS' AS iso, TRUE AS stable"),
    "current_values": ("SELECT CURRENT DATE = CURRENT_DATE AS d, CURRENT TIMESTAMP >= {ts '2020-01-01 00:00:00'} AS ts, char_length(CURRENT_TIME) AS t, {t '10:20:30'} AS given", "SELECT TRUE AS d, TRUE AS ts, 8 AS t, '10:20:30' AS given"),
    "limit_escape": ("SELECT o_orderkey FROM {orders} ORDER BY o_orderkey {limit 3 OFFSET 2}", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 3 OFFSET 2"),
    "qualified_star": ("SELECT n.*, r.r_name FROM {nation} n JOIN {region} AS r ON n.n_regionkey = r.r_regionkey", "SELECT n.*, r.r_name FROM {nation} n JOIN {region} AS r ON n.n_regionkey = r.r_regionkey"),
    "names_of_tables": ("SELECT nation.n_name, region.r_name, o.n FROM {nation} JOIN {region} ON nation.n_regionkey = region.r_regionkey LEFT JOIN (SELECT customer.c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY customer.c_nationkey) AS o ON o.k = nation.n_nationkey", "SELECT nation.n_name, region.r_name, o.n FROM {nation} JOIN {region} ON nation.n_regionkey = region.r_regionkey LEFT JOIN (SELECT customer.c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY customer.c_nationkey) AS o ON o.k = nation.n_nationkey"),
    "is_unknown": ("SELECT v.id, (v.x > 3) IS UNKNOWN AS u, (v.x > 3) IS NOT UNKNOWN AS k, (v.x > 3) IS NOT FALSE AS nf FROM (VALUES (1, 5), (2, NULL), (3, 0)) AS v(id, x)", "SELECT v.id, (v.x > 3) IS NULL AS u, (v.x > 3) IS NOT NULL AS k, coalesce(v.x > 3, TRUE) AS nf FROM (VALUES (1, 5), (2, NULL), (3, 0)) AS v(id, x)"),
    "integer_division": ("SELECT p_partkey, p_size / 7 AS q, (0 - p_size) / 7 AS nq, p_partkey / p_size AS wide, p_size / 7.0e0 AS exact, MOD(p_size, 7) AS r FROM {part} WHERE p_size / 2 * 2 = p_size", "SELECT p_partkey, CAST(p_size // 7 AS INTEGER) AS q, CAST(-(p_size // 7) AS INTEGER) AS nq, CAST(p_partkey // p_size AS BIGINT) AS wide, p_size / 7.0e0 AS exact, p_size % 7 AS r FROM {part} WHERE p_size % 2 = 0"),
    "integer_avg": ("SELECT l_returnflag, AVG(l_linenumber) AS mean, AVG(DISTINCT l_linenumber) AS some, SUM(l_linenumber) AS total, AVG(l_partkey) / COUNT(DISTINCT l_linenumber) AS part, round(AVG(l_quantity), 4) AS exact FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) // count(l_linenumber) AS INTEGER) AS mean, CAST(sum(DISTINCT l_linenumber) // count(DISTINCT l_linenumber) AS INTEGER) AS some, CAST(sum(l_linenumber) AS INTEGER) AS total, CAST((sum(l_partkey) // count(l_partkey)) // count(DISTINCT l_linenumber) AS BIGINT) AS part, round(avg(l_quantity), 4) AS exact FROM {lineitem} GROUP BY l_returnflag"),
    "integer_avg_over": ("SELECT p_partkey, AVG(p_size) OVER (PARTITION BY p_brand) AS mean FROM {part}", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand) // count(p_size) OVER (PARTITION BY p_brand) AS INTEGER) AS mean FROM {part}"),
    "length_of_numbers": ("SELECT p_partkey, LENGTH(p_size) AS n_size, LENGTH(p_partkey) AS n_key, LENGTH(p_retailprice) AS n_price, LENGTH(p_name) AS n_name, LENGTH(CAST(p_size AS DECIMAL(10, 2))) AS n_decimal FROM {part}", "SELECT p_partkey, 4 AS n_size, 8 AS n_key, 8 AS n_price, CAST(length(p_name) AS INTEGER) AS n_name, 6 AS n_decimal FROM {part}"),
    "quoted_names": ('SELECT "n_name" AS "The Name", t."n_regionkey" AS "a ""b""" FROM {nation} AS t WHERE "n_name" LIKE \'A%\' OR "n_name" = \'say "x"\'', 'SELECT "n_name" AS "The Name", t."n_regionkey" AS "a ""b""" FROM {nation} AS t WHERE "n_name" LIKE \'A%\''),
    "like_without_escape": ("SELECT v.id, v.s LIKE 'a\\b%' AS hit, v.s LIKE v.p AS own, v.s NOT LIKE 'a\\' || '_c' AS joined FROM (VALUES (1, 'a\\bc', 'a\\b_'), (2, 'abc', 'a\\%'), (3, 'a\\bx', '%\\%')) AS v(id, s, p)", "SELECT v.id, v.s LIKE 'a\\b%' AS hit, v.s LIKE v.p AS own, v.s NOT LIKE 'a\\' || '_c' AS joined FROM (VALUES (1, 'a\\bc', 'a\\b_'), (2, 'abc', 'a\\%'), (3, 'a\\bx', '%\\%')) AS v(id, s, p)"),
    "string_literals": ("SELECT 'it''s' AS a, 'back\\slash\\n' AS b, '\"q\"' AS c", "SELECT 'it''s' AS a, 'back\\slash\\n' AS b, '\"q\"' AS c"),
    "row_number_in_sql": ("SELECT count(*) AS n, min(t.r) AS lo, max(t.r) AS hi, count(DISTINCT t.r) AS d, count(DISTINCT t.o_orderkey) AS k FROM (SELECT ROW_NUMBER() OVER () AS r, o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 1000) AS t", "SELECT count(*) AS n, 1 AS lo, count(*) AS hi, count(*) AS d, count(*) AS k FROM {orders} WHERE o_totalprice > 1000"),
    "row_number_paged": ("SELECT t.r FROM (SELECT ROW_NUMBER() OVER () AS r, n_name FROM {nation}) AS t WHERE t.r <= 5", "SELECT r FROM range(1, 6) AS v(r)"),
    "xml_functions": ("SELECT n_nationkey, xpath_string(concat('<n k=\"', n_regionkey, '\"><name>', n_name, '</name></n>'), '/n/name') AS name, xpath_boolean(concat('<n k=\"', n_regionkey, '\"/>'), '/n[@k=1]') AS hit FROM {nation}", "SELECT n_nationkey, n_name AS name, n_regionkey = 1 AS hit FROM {nation}"),
    "join_properties": ("SELECT c.c_custkey, o.o_orderkey FROM {customer} c --SOME-PROPERTIES joinStrategy=HASH\n JOIN {orders} AS o --SOME-PROPERTIES joinStrategy = NESTEDLOOP\n ON o.o_custkey = c.c_custkey", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c JOIN {orders} AS o ON o.o_custkey = c.c_custkey"),
    "xml_by_name": ("SELECT n_nationkey, XMLSERIALIZE(XMLPARSE(DOCUMENT concat('<n k=\"', n_regionkey, '\"><name>', n_name, '</name></n>') PRESERVE WHITESPACE) AS CLOB) AS doc, XMLEXISTS('/n[@k=1]/name' PASSING BY REF XMLPARSE(DOCUMENT concat('<n k=\"', n_regionkey, '\"><name>', n_name, '</name></n>') PRESERVE WHITESPACE)) AS hit FROM {nation}", "SELECT n_nationkey, '<n k=\"' || n_regionkey || '\"><name>' || n_name || '</name></n>' AS doc, n_regionkey = 1 AS hit FROM {nation}"),
    "json_functions": ("SELECT event_id, to_json(named_struct('id', event_id, 'type', event_type)) AS js, get_json_object(to_json(named_struct('t', event_type)), '$.t') AS t FROM {events}", "SELECT event_id, '{{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}}' AS js, event_type AS t FROM {events}"),
}

_SETS = {"some": "SELECT c_nationkey FROM {customer} WHERE c_acctbal > 9000", "none": "SELECT c_nationkey FROM {customer} WHERE c_acctbal > 1e9", "nulls": "SELECT CASE WHEN n_nationkey > 7 THEN n_nationkey END FROM {nation}", "one": "SELECT 7 FROM {region}"}
for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "="), ("ne", "<>")):
    _columns = [(f"{q}_{kind}", q, text) for kind, text in _SETS.items() for q in ("all", "any")]
    # The twin counts what each comparison gives, pair by pair.
    _pair = f"count(*) FILTER (WHERE x {_op} v) AS t, count(*) FILTER (WHERE NOT (x {_op} v)) AS f, count(*) FILTER (WHERE (x {_op} v) IS NULL AND i IS NOT NULL) AS u"
    _case = {"all": "CASE WHEN f > 0 THEN FALSE WHEN u > 0 THEN NULL ELSE TRUE END", "any": "CASE WHEN t > 0 THEN TRUE WHEN u > 0 THEN NULL ELSE FALSE END"}
    _values = "SELECT nullif(n_nationkey, 3) AS x, n_nationkey AS id FROM {nation}"
    DIALECT[f"quantified_{_name}"] = (
        f"SELECT id, {', '.join(f'x {_op} {q.upper()} ({text}) AS {name}' for name, q, text in _columns)} FROM ({_values}) AS n",
        f"SELECT id, {', '.join(f'(SELECT {_case[q]} FROM (SELECT {_pair} FROM (SELECT 1 AS i, q.* FROM ({text}) AS q(v)))) AS {name}' for name, q, text in _columns)} FROM ({_values}) AS n",
    )
DIALECT["quantified_correlated"] = (
    "SELECT c_custkey FROM {customer} c WHERE c_acctbal * 30 > ALL (SELECT o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey) AND c_acctbal < SOME (SELECT s_acctbal FROM {supplier} WHERE s_nationkey = c.c_nationkey)",
    "SELECT c_custkey FROM {customer} c WHERE coalesce(c_acctbal * 30 > (SELECT max(o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey), TRUE) AND c_acctbal < (SELECT max(s_acctbal) FROM {supplier} WHERE s_nationkey = c.c_nationkey)",
)


def _int_avg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(scalar.int_avg(F.col("l_linenumber")).alias("mean"), scalar.int_avg(F.col("l_partkey")).alias("part"), scalar.int_sum(F.col("l_linenumber")).alias("total"))


def _mode(spark, d):
    return aggregates.mode(table(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority", "most")


def _geometric(spark, d):
    out = aggregates.GEOMETRIC_MEAN.over(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "g")
    return out.select("o_orderpriority", F.round("g", 4).alias("g"))


def _row_number(spark, d):
    return relational.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "rn", [F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey").asc_nulls_last()]).select("o_orderkey", "rn")


def _row_number_payload(spark, d):
    return relational.numbered(table(spark, d, "orders"), "rn", [F.col("o_custkey").desc_nulls_first(), F.col("o_orderkey").asc_nulls_last()]).select("rn", "o_orderkey", "o_orderstatus", "o_orderpriority")


def _next_value(spark, d):
    create_sequence("order_numbers", 1000, 5)
    first = run_sql(spark, d, "VALUES NEXT VALUE FOR order_numbers").select(F.lit(-1).cast("bigint").alias("k"), "next_value")
    rows = run_sql(spark, d, "SELECT NEXT VALUE FOR order_numbers AS v, o_orderkey FROM {orders}")
    # Which row gets which number is free; the numbers are not.
    summary = rows.agg(F.count_distinct("o_orderkey").alias("k"), (F.sum("v") + F.count_distinct("v")).alias("next_value"))
    return first.unionAll(summary).unionAll(run_sql(spark, d, "SELECT NEXT VALUE FOR order_numbers AS v FROM {region} WHERE r_regionkey = 0").select(F.lit(-2).cast("bigint"), "v"))


def _call(spark, d):
    create_procedure("top_orders", lambda spark, n, status: run_sql(spark, d, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = ? ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST ? ROWS ONLY", [status, n]))
    return call(spark, "{CALL top_orders(? + 2, 'F')}", [5])


def _registered_function(spark, d):
    register_function(spark, "millrace_initials", "string", lambda s: s.str.replace(r"[^A-Z]", "", regex=True))
    return run_sql(spark, d, "SELECT n_nationkey, millrace_initials(n_name) AS initials FROM {nation} WHERE LENGTH(millrace_initials(n_name)) > 5")


def _sql_parameters(spark, d):
    return run_sql(spark, d, "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus <> ? AND o_totalprice > ? ORDER BY o_orderkey OFFSET ? ROWS FETCH FIRST ? ROWS ONLY", ["it's?", 1000.5, 3, 11])


def _row_number_partitioned(spark, d):
    return relational.numbered(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "rn", [F.col("o_totalprice").desc_nulls_first(), F.col("o_orderkey").asc_nulls_last()], ["o_custkey"]).select("o_orderkey", "rn")


def _quantified(spark, d):
    """n_nationkey > ALL and > ANY of the keys of customers' nations with a large balance, by region."""
    c = table(spark, d, "customer").filter("c_acctbal > 9000").agg(F.min("c_nationkey").alias("lo"), F.max("c_nationkey").alias("hi"), F.count("c_nationkey").alias("n"), F.sum(F.col("c_nationkey").isNull().cast("bigint")).alias("nn"))
    x = table(spark, d, "nation").join(F.broadcast(c))
    args = (F.col("lo"), F.col("hi"), F.col("n"), F.coalesce("nn", F.lit(0)))
    return x.select("n_nationkey", scalar.quantified(F.col("n_nationkey"), ">=", *args, True).alias("every"), scalar.quantified(F.col("n_nationkey"), "<", *args, False).alias("some"))


def _not_in(spark, d):
    return relational.not_in(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", table(spark, d, "nation").filter("n_regionkey = 2").select("n_nationkey")).select("s_suppkey")


def _once(spark, d):
    biggest = table(spark, d, "orders").agg(F.max("o_totalprice"))
    return table(spark, d, "orders").filter(F.col("o_totalprice") == relational.once(biggest)).select("o_orderkey")


def _range_join(spark, d):
    tiers = spark.createDataFrame([("a", 0.0, 50000.0), ("b", 50000.01, 150000.0), ("c", 100000.0, 1000000.0)], "tier string, lo double, hi double")
    return relational.range_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), tiers, "o_totalprice", "lo", "hi", 50000.0).groupBy("tier").agg(F.count("*").alias("n"))


def _paged(spark, d):
    return relational.paged(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc_nulls_first(), F.col("c_custkey").asc_nulls_last()], 3, 5)


def _set_ops(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    sides = {"except": relational.except_(c, s, all=True), "intersect": relational.intersect(c, s, all=True), "except once": relational.except_(c, s), "intersect once": relational.intersect(s, c)}
    counted = [rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("side", F.lit(name)) for name, rows in sides.items()]
    return counted[0].unionAll(counted[1]).unionAll(counted[2]).unionAll(counted[3])


def _timestamp_of(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", scalar.timestamp_of(F.to_date("o_orderdate"), scalar.time_text(F.timestamp_seconds(F.col("o_orderkey") % 86400))).alias("at"))


def _insert(spark, d):
    r = table(spark, d, "region")
    return dml.insert(r, spark.sql("SELECT '7' AS r_regionkey"), {"r_name": F.lit("NEW")})


def _update(spark, d):
    return dml.update(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), {"c_acctbal": F.round(F.col("c_acctbal") * 2, 2), "c_mktsegment": F.lit("NONE")}, F.col("c_acctbal") < 0)


def _delete(spark, d):
    return dml.delete(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") < 100000)


def _cascade(spark, d):
    _, children = dml.delete_cascade(table(spark, d, "customer"), F.col("c_acctbal") < 0, table(spark, d, "orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey")
    return children


def _set_null(spark, d):
    _, children = dml.delete_cascade(table(spark, d, "customer"), F.col("c_acctbal") < 0, table(spark, d, "orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey", "set null")
    return children


def _merge(spark, d):
    target = table(spark, d, "nation").filter("n_nationkey < 15").select("n_nationkey", "n_name", "n_regionkey")
    source = table(spark, d, "nation").filter("n_nationkey >= 10")
    return dml.merge(target, source, ["n_nationkey"], matched_update={"n_name": F.concat(F.col("s.n_name"), F.lit("*"))}, matched_delete=F.col("t.n_nationkey") == 12, insert_values={"n_nationkey": F.col("s.n_nationkey"), "n_name": F.col("s.n_name"), "n_regionkey": F.col("s.n_regionkey")}, insert_when=F.col("s.n_nationkey") != 20)


def _merge_clauses(spark, d):
    """Every third order is cut, moved or cancelled by any of two conditions; orders of another key are added."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    source = orders.filter("o_orderkey % 3 = 0").select((F.col("o_orderkey") + F.when(F.col("o_custkey") % 10 == 0, 100_000_000).otherwise(0)).alias("k"), F.col("o_custkey").alias("c"), (F.col("o_totalprice") / 2).alias("p"))
    clauses = [
        dml.When(True, None, F.col("t.o_totalprice") < 20000),
        dml.When(True, {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("s.p")}, F.col("t.o_orderstatus") == "F"),
        dml.When(True, {"o_custkey": F.col("s.c") + 1}, F.col("t.o_orderstatus") == "O"),
        dml.When(False, {"o_orderkey": F.col("s.k"), "o_custkey": F.col("s.c")}, F.col("s.c") % 20 == 0),
        dml.When(False, {"o_orderkey": F.col("s.k"), "o_totalprice": F.lit(-1.0)}),
    ]
    return dml.merge_into(orders, source, (F.col("t.o_orderkey") == F.col("s.k")) & (F.col("t.o_custkey") == F.col("s.c")), clauses)


def _statements(spark, d):
    """One statement after the other over named tables, then what is left."""
    db = Database(spark, {"st_orders": table(spark, d, "orders"), "st_customer": table(spark, d, "customer")})
    db.execute("CREATE TABLE st_half AS SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM st_orders WHERE MOD(o_orderkey, 2) = 0 WITH DATA")
    db.execute("UPDATE st_half SET o_orderstatus = 'U', o_totalprice = o_totalprice * 2 WHERE o_custkey IN (SELECT c_custkey FROM st_customer WHERE c_acctbal < ?)", [0])
    db.execute("DELETE FROM st_half h WHERE h.o_totalprice < 20000")
    db.execute("INSERT INTO st_half (o_orderkey, o_custkey) SELECT o_orderkey + 100000000, o_custkey / 2 FROM st_orders WHERE MOD(o_orderkey, 100) = 1")
    db.execute("MERGE INTO st_half h USING st_orders o ON h.o_orderkey = o.o_orderkey WHEN MATCHED AND h.o_orderstatus = 'F' THEN DELETE WHEN MATCHED AND h.o_orderstatus = 'P' THEN UPDATE SET o_custkey = -1 WHEN NOT MATCHED AND o.o_totalprice > 300000 THEN INSERT (o_orderkey, o_totalprice) VALUES (o.o_orderkey, o.o_totalprice)")
    return db.execute("SELECT * FROM st_half")


def _cascade_levels(spark, d):
    tables = {"customer": table(spark, d, "customer").select("c_custkey", "c_acctbal"), "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey"), "lineitem": table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")}
    references = [dml.Reference("orders", ("o_custkey",), "customer", ("c_custkey",), "cascade"), dml.Reference("lineitem", ("l_orderkey",), "orders", ("o_orderkey",), "cascade")]
    return dml.delete_from(tables, references, "customer", F.col("c_acctbal") < 0)["lineitem"]


def _cascade_self(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey div 2").alias("parent"))
    return dml.delete_from({"orders": orders}, [dml.Reference("orders", ("parent",), "orders", ("o_orderkey",), "cascade")], "orders", F.col("o_orderkey").isin(5, 12, 33))["orders"]


def _foreign_key(spark, d):
    parents = table(spark, d, "customer").filter("c_custkey % 3 <> 0")
    return dml.check_foreign_key(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey")


def _check(spark, d):
    return dml.check(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), F.col("l_discount") < 0.09)


def _generated(spark, d):
    return dml.generated(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), {"gross": F.round(F.col("l_quantity") * 3, 2)})


def _transitions(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = dml.update(old, {"c_mktsegment": F.lit("X")}, F.col("c_custkey") % 50 == 0)
    before, after = dml.transitions(old, new, ["c_custkey"])
    return before.withColumn("side", F.lit("old")).unionAll(after.withColumn("side", F.lit("new")))


def _lengths(spark, d):
    df = table(spark, d, "part")
    kinds = dict(df.dtypes)
    return df.select("p_partkey", *(scalar.length_of(F.col(c), kinds[c]).cast("int").alias(f"n_{c}") for c in ("p_size", "p_name", "p_retailprice", "p_partkey")))


def _char(spark, d):
    v = spark.sql("SELECT * FROM VALUES (1, 'ab', 'ab  '), (2, 'ab', 'abc'), (3, '', '  ') AS v(id, a, b)")
    return v.select("id", scalar.char_equal(F.col("a"), F.col("b")).alias("same"), scalar.char_pad(F.col("a"), 4).alias("padded"))


def _dates(spark, d):
    return table(spark, d, "part").select("p_partkey", F.date_format(scalar.date_of_number(F.col("p_partkey")), "yyyy-MM-dd").alias("day"), scalar.time_text(F.timestamp_seconds(F.col("p_partkey") * 61)).alias("time"))


def _search(spark, d):
    return search.search(table(spark, d, "documents"), "doc_id", "text", "trash clown idiot", start=0, window=None)


def _search_page(spark, d):
    return search.search(table(spark, d, "documents"), "doc_id", "text", "the token clown", start=5, window=20)


def _json_round(spark, d):
    js = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("js"))
    return files.json_array(js, "js", "n_nationkey int, n_name string")


def _strings(spark, d):
    from pyspark.sql import types as T

    rows = table(spark, d, "nation").select(*(F.col(c).cast("string") for c in ("n_nationkey", "n_name")))
    return files.string_columns(rows, T.StructType([T.StructField("k", T.IntegerType()), T.StructField("name", T.StringType())]))


def _tumbling(spark, d):
    w = windows.tumbling(table(spark, d, "events"), "ts", ["event_type"], "1 hour", "value")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _materialized(spark, d):
    from ..operators.materialize import materialize

    return materialize(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))).filter("n > 10")


def _external_round_trip(spark, d):
    from ..operators.materialize import new_path

    path = new_path(spark, "export")
    files.export_delimited(table(spark, d, "nation"), path, column=";")
    return files.import_delimited(spark, path, table(spark, d, "nation").schema, column=";")


def _search_sql(terms: list[str], end: str) -> str:
    each = lambda text, by: by.join(text.format(i=i, t=t) for i, t in enumerate(terms))
    return f"""
        WITH w AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+') AS w FROM {{documents}}),
        t AS (SELECT doc_id, {each("len(list_filter(w, lambda x: x = '{t}')) AS n{i}", ", ")} FROM w), c AS (SELECT count(*) AS n, {each("count(*) FILTER (WHERE n{i} > 0) AS d{i}", ", ")} FROM t)
        SELECT doc_id, round({each("sqrt(n{i}) * ln((1 + n) / (1 + d{i}))", " + ")}, 6) AS score FROM t, c WHERE {each("n{i} > 0", " OR ")} {end}"""


FRAMES = {
    "integer_avg_sum": (_int_avg, "SELECT l_returnflag, CAST(sum(l_linenumber) // count(l_linenumber) AS BIGINT) AS mean, CAST(sum(l_partkey) // count(l_partkey) AS BIGINT) AS part, CAST(sum(l_linenumber) AS INTEGER) AS total FROM {lineitem} GROUP BY l_returnflag"),
    "udaf_mode": (_mode, "SELECT o_orderstatus, min(o_orderpriority) AS most FROM (SELECT o_orderstatus, o_orderpriority, rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) AS r FROM {orders} GROUP BY 1, 2) WHERE r = 1 GROUP BY o_orderstatus"),
    "udaf_geometric_mean": (_geometric, "SELECT o_orderpriority, round(exp(avg(ln(o_totalprice))), 4) AS g FROM {orders} WHERE o_totalprice > 0 GROUP BY o_orderpriority"),
    "row_number_global": (_row_number, "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM {orders}"),
    "row_number_payload": (_row_number_payload, "SELECT row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS rn, o_orderkey, o_orderstatus, o_orderpriority FROM {orders}"),
    "next_value": (_next_value, "WITH o AS (SELECT 1000 + 5 * row_number() OVER () AS v FROM {orders}) SELECT -1 AS k, 1000 AS next_value UNION ALL SELECT count(*), CAST(sum(v) AS BIGINT) + count(*) FROM o UNION ALL SELECT -2, 1005 + 5 * count(*) FROM o"),
    "call_procedure": (_call, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 7"),
    "registered_function": (_registered_function, "SELECT n_nationkey, regexp_replace(n_name, '[^A-Z]', '', 'g') AS initials FROM {nation} WHERE length(regexp_replace(n_name, '[^A-Z]', '', 'g')) > 5"),
    "sql_parameters": (_sql_parameters, "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_totalprice > 1000.5 ORDER BY o_orderkey LIMIT 11 OFFSET 3"),
    "row_number_partitioned": (_row_number_partitioned, "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}"),
    "quantified_all_any": (_quantified, "SELECT n_nationkey, coalesce(n_nationkey >= (SELECT max(c_nationkey) FROM {customer} WHERE c_acctbal > 9000), TRUE) AS every, coalesce(n_nationkey < (SELECT max(c_nationkey) FROM {customer} WHERE c_acctbal > 9000), FALSE) AS some FROM {nation}"),
    "not_in_operator": (_not_in, "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)"),
    "scalar_once": (_once, "SELECT o_orderkey FROM {orders} WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders})"),
    "range_join": (_range_join, "SELECT tier, count(*) AS n FROM {orders} JOIN (VALUES ('a', 0.0, 50000.0), ('b', 50000.01, 150000.0), ('c', 100000.0, 1000000.0)) AS t(tier, lo, hi) ON o_totalprice BETWEEN lo AND hi GROUP BY tier"),
    "paged": (_paged, "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 5 OFFSET 3"),
    "set_operations_all": (_set_ops, "WITH c AS (SELECT c_nationkey AS k FROM {customer}), s AS (SELECT s_nationkey AS k FROM {supplier}), o AS (SELECT 'except' AS side, k FROM (FROM c EXCEPT ALL FROM s) UNION ALL SELECT 'intersect', k FROM (FROM c INTERSECT ALL FROM s) UNION ALL SELECT 'except once', k FROM (FROM c EXCEPT FROM s) UNION ALL SELECT 'intersect once', k FROM (FROM s INTERSECT FROM c)) SELECT side, k, count(*) AS n FROM o GROUP BY side, k"),
    "timestamp_of": (_timestamp_of, "SELECT o_orderkey, CAST(o_orderdate AS DATE) + to_seconds(o_orderkey % 86400) AS at FROM {orders}"),
    "insert_normalized": (_insert, "SELECT * FROM {region} UNION ALL SELECT 7, 'NEW'"),
    "update": (_update, "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN round(c_acctbal * 2, 2) ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM {customer}"),
    "delete": (_delete, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE NOT o_totalprice < 100000"),
    "delete_cascade": (_cascade, "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0)"),
    "delete_set_null": (_set_null, "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM {orders}"),
    "merge": (_merge, "SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 10 AND 14 THEN n_name || '*' ELSE n_name END AS n_name, n_regionkey FROM {nation} WHERE n_nationkey NOT IN (12, 20)"),
    "statements": (_statements, """
        WITH half AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0) THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
                             CASE WHEN o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0) THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM {orders} WHERE o_orderkey % 2 = 0),
        kept AS (SELECT * FROM half WHERE o_totalprice >= 20000)
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM kept WHERE o_orderstatus <> 'F'
        UNION ALL SELECT o_orderkey + 100000000, o_custkey // 2, NULL, NULL FROM {orders} WHERE o_orderkey % 100 = 1
        UNION ALL SELECT o_orderkey, NULL, NULL, o_totalprice FROM {orders} WHERE o_totalprice > 300000 AND o_orderkey NOT IN (SELECT o_orderkey FROM kept)"""),
    "merge_clauses": (_merge_clauses, """
        WITH s AS (SELECT o_orderkey + CASE WHEN o_custkey % 10 = 0 THEN 100000000 ELSE 0 END AS k, o_custkey AS c, o_totalprice / 2 AS p FROM {orders} WHERE o_orderkey % 3 = 0)
        SELECT o_orderkey, CASE WHEN k IS NOT NULL AND o_orderstatus = 'O' THEN c + 1 ELSE o_custkey END AS o_custkey, CASE WHEN k IS NOT NULL AND o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN k IS NOT NULL AND o_orderstatus = 'F' THEN p ELSE o_totalprice END AS o_totalprice
        FROM {orders} LEFT JOIN s ON o_orderkey = k AND o_custkey = c WHERE k IS NULL OR o_totalprice >= 20000
        UNION ALL SELECT k, CASE WHEN c % 20 = 0 THEN c END, NULL, CASE WHEN c % 20 = 0 THEN NULL ELSE -1.0 END FROM s WHERE k > 100000000"""),
    "delete_cascade_levels": (_cascade_levels, "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0))"),
    "delete_cascade_self": (_cascade_self, "WITH RECURSIVE dead AS (SELECT o_orderkey AS k FROM {orders} WHERE o_orderkey IN (5, 12, 33) UNION SELECT o_orderkey FROM {orders} JOIN dead ON o_orderkey // 2 = k) SELECT o_orderkey, o_orderkey // 2 AS parent FROM {orders} WHERE o_orderkey NOT IN (SELECT k FROM dead)"),
    "foreign_key_check": (_foreign_key, "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_custkey % 3 <> 0)"),
    "check_constraint": (_check, "SELECT l_orderkey, l_linenumber, l_discount FROM {lineitem} WHERE NOT l_discount < 0.09"),
    "generated_column": (_generated, "SELECT l_orderkey, l_linenumber, l_quantity, round(l_quantity * 3, 2) AS gross FROM {lineitem}"),
    "transition_tables": (_transitions, "SELECT c_custkey, c_mktsegment, 'old' AS side FROM {customer} WHERE c_custkey % 50 = 0 UNION ALL SELECT c_custkey, 'X', 'new' FROM {customer} WHERE c_custkey % 50 = 0"),
    "length_by_type": (_lengths, "SELECT p_partkey, 4 AS n_p_size, CAST(length(p_name) AS INTEGER) AS n_p_name, 8 AS n_p_retailprice, 8 AS n_p_partkey FROM {part}"),
    "char_semantics": (_char, "SELECT * FROM (VALUES (1, TRUE, 'ab  '), (2, FALSE, 'ab  '), (3, TRUE, '    ')) AS v(id, same, padded)"),
    "date_of_number": (_dates, "SELECT p_partkey, strftime(DATE '1970-01-01' + CAST(p_partkey - 1 AS INTEGER), '%Y-%m-%d') AS day, strftime(make_timestamp(p_partkey * 61 * 1000000), '%H:%M:%S') AS time FROM {part}"),
    "text_search": (_search, _search_sql(["trash", "clown", "idiot"], "")),
    "text_search_page": (_search_page, _search_sql(["the", "token", "clown"], "ORDER BY score DESC, doc_id LIMIT 20 OFFSET 5")),
    "json_array_rows": (_json_round, "SELECT n_nationkey, n_name FROM {nation}"),
    "string_columns": (_strings, "SELECT n_nationkey AS k, n_name AS name FROM {nation}"),
    "tumbling_window": (_tumbling, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2"),
    "materialized": (_materialized, "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 10"),
    "delimited_round_trip": (_external_round_trip, "SELECT * FROM {nation}"),
}


def dialect_query(sql: str):
    return lambda spark, d: run_sql(spark, d, sql)
