"""Queries through files, table functions, user-defined functions, views and parameters, each with the SQL that DuckDB runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..catalog import TABLES, table
from ..operators import relational
from ..operators.cursor import Cursor
from ..operators.materialize import new_path
from ..plans import diagnostics
from ..sources import files
from ..sources.functions import RestrictedSource, load, register_table_function, satisfies


def _xml(spark, d):
    path = new_path(spark, "xml")
    table(spark, d, "nation").write.format("xml").options(rootTag="nations", rowTag="nation").save(path)
    return files.read_xml(spark, path, "nation", "n_nationkey INT, n_name STRING, n_regionkey INT")


def _json(spark, d):
    path = new_path(spark, "json")
    orders = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("o_custkey"), "o_orderpriority")
    files.export_json_array(orders, path, [F.col("o_orderkey")])
    return files.import_json_array(spark, path, "o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING")


def _lobs(spark, d):
    out, lobs = new_path(spark, "export"), new_path(spark, "lobs")
    pages = table(spark, d, "pages")
    files.export_delimited(pages, out, lob_path=lobs, lobs=("html",))
    return files.import_delimited(spark, out, pages.schema, lob_path=lobs, lobs=("html",)).select("page_id", "url", F.sha2("html", 256).alias("html"))


def _lines(spark, d):
    path = new_path(spark, "lines")
    table(spark, d, "nation").select(F.concat_ws(" = ", F.col("n_name"), F.col("n_nationkey").cast("string"))).write.text(path)
    return files.read_properties(spark, path).select("key", F.col("value").cast("int").alias("value"))


def _table_function(spark, d):
    def split(name: str, n: int) -> Iterator[tuple]:
        for i in range(n):
            yield name, i

    register_table_function(spark, "millrace_split", "name STRING, i INT", split)
    nation = table(spark, d, "nation")
    return spark.sql("SELECT t.name, t.i FROM {nation} n, LATERAL millrace_split(n.n_name, n.n_regionkey) AS t", nation=nation)


class Squares(RestrictedSource):
    """n and its square, n from 0 to 9,999."""

    fields = {"n": "BIGINT", "square": "BIGINT", "unused": "STRING"}
    rows = 10_000
    rows_in_slice = 1_250

    @classmethod
    def name(cls) -> str:
        return "millrace_squares"

    def scan(self, number: int, of: int, restrictions: list, columns: list[str]) -> Iterator[tuple]:
        low = max((v for c, op, v in restrictions if c == "n" and op in (">", ">=", "=")), default=0)
        for n in range(number + (max(low - number, 0) + of - 1) // of * of, 10_000, of):
            row = {"n": n, "square": n * n, "unused": str(n)}
            if all(satisfies(row[c], op, v) for c, op, v in restrictions):
                yield tuple(row[c] for c in columns)


def _restricted(spark, d):
    return load(spark, Squares, ["n", "square"]).filter("n >= 9000 AND square < 90000000")


def _restricted_columns(spark, d):
    return load(spark, Squares, ["square"]).filter("square > 99000000").join(table(spark, d, "region").select("r_regionkey"), F.col("square") % 7 == F.col("r_regionkey"))


def _udf(spark, d):
    @F.pandas_udf("string")
    def initials(s: pd.Series) -> pd.Series:
        return s.str.replace(r"[^A-Z]", "", regex=True)

    return table(spark, d, "nation").select("n_nationkey", initials("n_name").alias("initials"))


def _sequence(spark, d):
    rows = relational.numbered(table(spark, d, "region"), "k", [F.col("r_regionkey").asc_nulls_last()])
    return rows.select("r_name", (F.lit(100) + 10 * (F.col("k") - 1)).cast("bigint").alias("id"))


def _view(spark, d):
    spark.sql("SELECT n_name, n_regionkey FROM {nation} WHERE n_regionkey < 3", nation=table(spark, d, "nation")).createOrReplaceTempView("millrace_inner")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW millrace_outer AS SELECT n_regionkey, count(*) AS n FROM millrace_inner GROUP BY n_regionkey")
    return spark.table("millrace_outer")


def _parameters(spark, d):
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_orderstatus = ? AND o_totalprice > ?", args=["F", 250000.0], orders=table(spark, d, "orders"))


def _cursor(spark, d):
    """Rows 11 to 20, the last one, and the one three before it."""
    c = Cursor(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey")])
    single = spark.createDataFrame([tuple(c.last()), tuple(c.relative(-3))], "o_orderkey bigint, o_totalprice double")
    return c.rows(11, 20).unionAll(single)


def _current_of(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    c = Cursor(orders, [F.col("o_totalprice").desc_nulls_first(), F.col("o_orderkey")])
    c.first()
    orders = c.update_current(orders, ["o_orderkey"], {"o_orderstatus": F.lit("!"), "o_totalprice": F.col("o_totalprice") + 1})
    c.absolute(-1)
    return c.delete_current(orders, ["o_orderkey"])


def _access_log(spark, d):
    path = new_path(spark, "log")
    o = table(spark, d, "orders")
    line = F.format_string('10.0.%d.%d - - [%s +0000] "GET /orders/%d HTTP/1.1" %d %d', (F.col("o_custkey") % 256).cast("int"), (F.col("o_orderkey") % 256).cast("int"), F.date_format("o_orderdate", "dd/MM/yyyy:HH:mm:ss"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", 200).otherwise(404), F.col("o_orderkey") * 3)
    o.select(F.when(F.col("o_orderkey") % 50 == 0, "no log line").otherwise(line)).write.text(path)
    log = files.read_lines(spark, path, files.ACCESS_LOG, ["host", "ident", "user", "time", "request", "status", "bytes"])
    return log.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("bytes").cast("bigint")).alias("bytes"), F.count_distinct("request").alias("requests"))


def _space(spark, d):
    return diagnostics.space(spark, d).select("name", "n_rows", (F.col("bytes") > 0).alias("has_bytes"))


def _columns(spark, d):
    return diagnostics.columns(spark, d, ("nation", "orders")).select("table", "number", "column")


FRAMES = {
    "access_log": (_access_log, "SELECT CASE WHEN o_orderstatus = 'F' THEN '200' ELSE '404' END AS status, count(*) AS n, CAST(sum(o_orderkey * 3) AS BIGINT) AS bytes, count(DISTINCT o_orderkey) AS requests FROM {orders} WHERE o_orderkey % 50 <> 0 GROUP BY 1"),
    "table_space": (_space, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, TRUE AS has_bytes FROM {{{t}}}" for t in TABLES)),
    "table_columns": (_columns, "SELECT table_name AS \"table\", column_index AS number, column_name AS \"column\" FROM duckdb_columns() WHERE table_name IN ('nation', 'orders') AND database_name = current_database()"),
    "xml_round_trip": (_xml, "SELECT * FROM {nation}"),
    "json_round_trip": (_json, "SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS o_custkey, o_orderpriority FROM {orders}"),
    "lob_round_trip": (_lobs, "SELECT page_id, url, sha256(html) AS html FROM {pages}"),
    "property_lines": (_lines, "SELECT n_name AS key, n_nationkey AS value FROM {nation}"),
    "table_function": (_table_function, "SELECT n_name AS name, CAST(i AS INTEGER) AS i FROM {nation}, range(0, 10) AS r(i) WHERE i < n_regionkey"),
    "restricted_source": (_restricted, "SELECT n, n * n AS square FROM range(0, 10000) AS r(n) WHERE n >= 9000 AND n * n < 90000000"),
    "restricted_columns": (_restricted_columns, "SELECT n * n AS square, r_regionkey FROM range(0, 10000) AS r(n) JOIN {region} ON (n * n) % 7 = r_regionkey WHERE n * n > 99000000"),
    "scalar_udf": (_udf, "SELECT n_nationkey, regexp_replace(n_name, '[^A-Z]', '', 'g') AS initials FROM {nation}"),
    "sequence": (_sequence, "SELECT r_name, 100 + 10 * (row_number() OVER (ORDER BY r_regionkey) - 1) AS id FROM {region}"),
    "view_over_view": (_view, "SELECT n_regionkey, count(*) AS n FROM {nation} WHERE n_regionkey < 3 GROUP BY n_regionkey"),
    "parameters": (_parameters, "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 250000"),
    "cursor_rows": (_cursor, "WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n, count(*) OVER () AS k FROM {orders}) SELECT o_orderkey, o_totalprice FROM o WHERE n BETWEEN 11 AND 20 OR n IN (k, k - 3)"),
    "current_of": (_current_of, "WITH o AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER () AS k FROM {orders}) SELECT o_orderkey, CASE WHEN n = 1 THEN '!' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN n = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM o WHERE n < k"),
}
