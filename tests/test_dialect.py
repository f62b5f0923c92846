import pytest
from pyspark.errors import PySparkException

from millrace.dialect import PagingError, UnsupportedError, rewrite


def test_literals_and_comments_stay():
    assert rewrite("SELECT 'ORDER BY x FETCH FIRST 2 ROWS ONLY' -- ORDER BY y\n") == "SELECT 'ORDER BY x FETCH FIRST 2 ROWS ONLY' -- ORDER BY y\n"


def test_nulls_are_high():
    assert rewrite("SELECT x FROM t ORDER BY x, f(a, b) DESC, z NULLS FIRST") == "SELECT x FROM t ORDER BY x NULLS LAST, f(a, b) DESC NULLS FIRST, z NULLS FIRST"
    assert rewrite("row_number() OVER (PARTITION BY a ORDER BY b)") == "row_number() OVER (PARTITION BY a ORDER BY b NULLS LAST)"


def test_paging():
    assert rewrite("SELECT 1 OFFSET 2 ROWS FETCH NEXT 3 ROWS ONLY") == "SELECT 1 LIMIT 3 OFFSET 2"
    assert rewrite("SELECT 1 FETCH FIRST ROW ONLY") == "SELECT 1 LIMIT 1"
    for bad in ("SELECT 1 OFFSET -1 ROWS", "SELECT 1 FETCH FIRST 0 ROWS ONLY"):
        with pytest.raises(PagingError):
            rewrite(bad)


def test_escapes():
    assert rewrite("SELECT {fn ucase(a)} FROM t WHERE d > {d '2000-01-01'}") == "SELECT upper(a) FROM t WHERE d > DATE '2000-01-01'"


def test_values_with_subqueries():
    assert rewrite("SELECT * FROM (VALUES (1, (SELECT max(a) FROM t)), (2, f(3))) AS v(x, y)") == "SELECT * FROM (SELECT 1, (SELECT max(a) FROM t) UNION ALL SELECT 2, f(3)) AS v(x, y)"


def test_division_by_zero_is_an_error(spark):
    with pytest.raises(PySparkException):
        spark.sql("SELECT a DIV b FROM VALUES (1, 0) AS v(a, b)").collect()


def test_quoted_names_beside_literals():
    assert rewrite("SELECT \"n\" AS \"a \"\"b\"\"\" FROM t WHERE \"n\" = 'say \"x\"'") == "SELECT `n` AS `a \"b\"` FROM t WHERE `n` = 'say \"x\"'"


def test_parameters():
    assert rewrite("SELECT ? FROM t WHERE a = '?' AND b = ? OFFSET ? ROWS FETCH FIRST ? ROWS ONLY", ["it's", None, 2, 3]) == "SELECT 'it''s' FROM t WHERE a = '?' AND b = NULL LIMIT 3 OFFSET 2"
    with pytest.raises(ValueError):
        rewrite("SELECT ?", [])
    with pytest.raises(PagingError):
        rewrite("SELECT 1 FETCH FIRST ? ROWS ONLY", [0])
    with pytest.raises(PagingError):
        rewrite("SELECT 1 OFFSET ? ROWS", [None])


def test_frac_second_is_not_taken_for_something_else():
    with pytest.raises(UnsupportedError):
        rewrite("SELECT {fn timestampadd(SQL_TSI_FRAC_SECOND, 1, x)}")


def test_integer_division_by_types(spark):
    from pyspark.sql import functions as F

    from millrace.catalog import execute

    spark.createDataFrame([(7, 2, 2.0)], "a INT, b BIGINT, c DOUBLE").createOrReplaceTempView("typed_test")
    row = execute(spark, "SELECT a / 2 * 2 / 3 AS x, (a + 1) / (b / 1) AS y, a / c AS z, -a / 2 AS n, CASE WHEN a / 2 = 3 THEN a / b END AS w, (SELECT max(a / 4) FROM typed_test) AS s FROM typed_test WHERE a / 5 = 1").first()
    assert tuple(row) == (2, 4, 3.5, -3, 3, 1)
    assert dict(execute(spark, "SELECT a / a AS i, a / b AS l, sum(a) AS s, avg(b) AS m FROM typed_test GROUP BY a, b").dtypes) == {"i": "int", "l": "bigint", "s": "int", "m": "bigint"}
    with pytest.raises(PySparkException):
        execute(spark, "SELECT a / 0 FROM typed_test").collect()
    big = spark.range(3).select(F.lit(2**31 - 1).cast("int").alias("a"))
    big.createOrReplaceTempView("typed_big")
    assert execute(spark, "SELECT avg(a) AS m FROM typed_big").first()["m"] == 2**31 - 1
    with pytest.raises(PySparkException):
        execute(spark, "SELECT sum(a) FROM typed_big").collect()


def test_join_properties_become_hints(spark):
    from millrace.queries import QUERIES

    plan = QUERIES["join_properties"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
