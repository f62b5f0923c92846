import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import aggregates, scalar
from millrace.operators import dml, relational
from millrace.plans import explain
from millrace.sources import files, functions
from millrace.streaming import windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_row_number_without_partition(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    out = relational.numbered(df, "rn", [F.col("x").asc_nulls_last()])
    assert rows(out) == rows(spark.range(1000).select("id", F.col("id") + 1))


def test_quantified(spark):
    v = spark.sql("SELECT * FROM VALUES (5, 1, 9, 2L, 0L), (5, 1, 3, 2L, 1L), (5, NULL, NULL, 0L, 0L), (NULL, 1, 2, 2L, 0L) AS v(x, lo, hi, n, nn)")
    args = [F.col(c) for c in ("lo", "hi", "n", "nn")]
    got = v.select(scalar.quantified(F.col("x"), ">", *args, True), scalar.quantified(F.col("x"), ">", *args, False)).collect()
    assert [tuple(r) for r in got] == [(False, True), (None, True), (True, False), (None, None)]


def test_scalar_subquery(spark):
    assert spark.range(1).select(relational.once(spark.range(0))).first()[0] is None
    with pytest.raises(relational.CardinalityError):
        relational.once(spark.range(2))


def test_not_in_with_nulls(spark):
    x = spark.sql("SELECT * FROM VALUES (1), (NULL), (3) AS v(x)")
    assert relational.not_in(x, "x", spark.sql("SELECT CAST(NULL AS INT) AS y UNION ALL SELECT 1")).count() == 0
    assert relational.not_in(x, "x", spark.sql("SELECT 1 AS y WHERE 1 = 0")).count() == 3
    assert rows(relational.not_in(x, "x", spark.sql("SELECT 1 AS y"))) == [(3,)]


def test_paging_limits(spark):
    for offset, fetch in ((-1, None), (None, 1), (0, 0)):
        with pytest.raises(ValueError):
            relational.paged(spark.range(3), [F.col("id")], offset, fetch)
    assert rows(relational.paged(spark.range(9), [F.col("id").desc()], 2, 2)) == [(5,), (6,)]


def test_merge_finds_double_matches(spark):
    target, source = spark.sql("SELECT 1 AS k, 'a' AS v"), spark.sql("SELECT * FROM VALUES (1, 'b'), (1, 'c') AS s(k, v)")
    with pytest.raises(PySparkException, match="acts twice"):
        dml.merge(target, source, ["k"], matched_update={"v": F.col("s.v")}).collect()
    # Two pairs of which a clause takes one are no error.
    once = dml.merge_into(target, source, F.col("t.k") == F.col("s.k"), [dml.When(True, {"v": F.col("s.v")}, F.col("s.v") == "c")])
    assert [tuple(r) for r in once.collect()] == [(1, "c")]


def test_merge_with_any_condition(spark):
    target = spark.sql("SELECT * FROM VALUES (1, 'a'), (5, 'b'), (9, 'c'), (CAST(NULL AS INT), 'n') AS t(k, v)")
    source = spark.sql("SELECT * FROM VALUES (0, 2, 'x'), (8, 20, 'y'), (30, 40, 'z'), (CAST(NULL AS INT), 1, 'w') AS s(lo, hi, v)")
    clauses = [dml.When(True, None, F.col("s.v") == "y"), dml.When(True, {"v": F.concat("t.v", "s.v")}), dml.When(False, {"k": F.col("s.hi")}, F.col("s.lo") > 0)]
    got = dml.merge_into(target, source, F.col("t.k").between(F.col("s.lo"), F.col("s.hi")), clauses).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "ax"), (5, "b"), (None, "n"), (40, None)], key=repr)


def test_cascades_over_levels_and_circles(spark):
    staff = spark.sql("SELECT * FROM VALUES (1, CAST(NULL AS INT), 10), (2, 1, 10), (3, 2, 20), (4, 9, 20), (9, 4, 20) AS s(id, boss, unit)")
    unit = spark.sql("SELECT * FROM VALUES (10, 1), (20, 4), (30, CAST(NULL AS INT)) AS u(unit, head)")
    notes = spark.sql("SELECT * FROM VALUES ('a', 3), ('b', 9), ('c', CAST(NULL AS INT)) AS n(note, about)")
    tables = {"staff": staff, "unit": unit, "notes": notes}
    references = [dml.Reference("staff", ("boss",), "staff", ("id",), "cascade"), dml.Reference("staff", ("unit",), "unit", ("unit",), "cascade"), dml.Reference("unit", ("head",), "staff", ("id",), "cascade"), dml.Reference("notes", ("about",), "staff", ("id",), "set null")]
    out = dml.delete_from(tables, references, "staff", F.col("id") == 1)
    assert sorted(tuple(r) for r in out["staff"].collect()) == [(4, 9, 20), (9, 4, 20)]
    assert sorted(r["unit"] for r in out["unit"].collect()) == [20, 30]
    assert sorted((r["note"], r["about"] or 0) for r in out["notes"].collect()) == [("a", 0), ("b", 9), ("c", 0)]
    out = dml.delete_from(tables, references, "unit", F.col("unit") == 20)
    assert sorted(r["id"] for r in out["staff"].collect()) == [1, 2]
    with pytest.raises(dml.ConstraintError):
        dml.delete_from(tables, [*references[:3], dml.Reference("notes", ("about",), "staff", ("id",))], "staff", F.col("id") == 4)


def test_numbering_keeps_every_row(spark):
    rows = spark.range(1_000_000).select((F.col("id") * 7919 % 100_003).alias("x"), F.concat(F.lit("payload "), F.col("id")).alias("p"))
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        for order in ([F.col("x").desc()], []):
            out = relational.numbered(rows, "n", order).agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("p")).first()
            assert tuple(out) == (1_000_000, 1_000_000, 1, 1_000_000, 1_000_000)
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_range_join_with_wide_and_narrow_intervals(spark):
    points = spark.range(0, 300).select((F.col("id") / 3).alias("at"))
    spans = spark.sql("SELECT * FROM VALUES (0.0D, 0.0D), (-1e9D, 1e9D), (5.5D, 6.5D), (20.0D, 80.0D), (9.0D, 3.0D), (CAST(NULL AS DOUBLE), 4.0D) AS s(lo, hi)")
    got = relational.range_join(points, spans, "at", "lo", "hi", 0.5)
    want = points.join(spans, F.col("at").between(F.col("lo"), F.col("hi")))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_delete_restrict(spark):
    parent, child = spark.sql("SELECT 1 AS p"), spark.sql("SELECT 1 AS c")
    with pytest.raises(dml.ConstraintError):
        dml.delete_cascade(parent, F.col("p") == 1, child, "p", "c", "restrict")


def test_normalize_rejects_values_that_do_not_fit(spark):
    target = spark.sql("SELECT CAST(1 AS SMALLINT) AS x")
    with pytest.raises(PySparkException):
        dml.insert(target, spark.sql("SELECT 100000 AS x")).collect()


def test_identity_is_unique(spark):
    assert dml.identity(spark.range(100).repartition(5), "k", 10, 5).select("k").distinct().count() == 100


def test_integer_aggregates(spark):
    v = spark.sql("SELECT * FROM VALUES (2147483647), (1) AS v(x)")
    assert v.agg(scalar.int_avg(F.col("x"))).first()[0] == 1073741824
    assert v.filter("x > 9e9").agg(scalar.int_avg(F.col("x"))).first()[0] is None
    with pytest.raises(PySparkException):
        v.agg(scalar.int_sum(F.col("x"))).collect()


def test_mode_and_its_ties(spark):
    v = spark.sql("SELECT * FROM VALUES ('a', 2), ('a', 1), ('a', NULL), ('b', NULL) AS v(k, x)")
    assert rows(aggregates.mode(v, ["k"], "x", "m")) == [("a", 1)]


def test_char(spark):
    with pytest.raises(PySparkException):
        spark.sql("SELECT 'abcde' AS x").select(scalar.char_pad(F.col("x"), 3)).collect()


def test_delimited_files_keep_nulls_quotes_and_lobs(spark, tmp_path):
    df = spark.sql("""SELECT * FROM VALUES (1, 'a,"b"', 'x'), (2, '', 'y'), (3, NULL, 'z') AS v(id, s, big)""")
    files.export_delimited(df, str(tmp_path / "out"), lob_path=str(tmp_path / "lobs"), lobs=("big",))
    back = files.import_delimited(spark, str(tmp_path / "out"), df.schema, lob_path=str(tmp_path / "lobs"), lobs=("big",))
    assert rows(back) == rows(df)


def test_xml_json_and_lines(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><p><n>1</n><s>x</s></p><p><n>2</n></p></r>")
    assert rows(files.read_xml(spark, str(tmp_path / "a.xml"), "p", "n INT, s STRING")) == [(1, "x"), (2, None)]
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2, "b": "z"}]')
    assert rows(files.read_json_array(spark, str(tmp_path / "a.json"), "a INT, b STRING")) == [(1, None), (2, "z")]
    (tmp_path / "p.txt").write_text("# c\na = 1\n\nb: two\n")
    assert rows(files.read_properties(spark, str(tmp_path / "p.txt"))) == [("a", "1"), ("b", "two")]
    (tmp_path / "log").write_text('1.2.3.4 - u [10/Oct/2000] "GET / HTTP/1.0" 200 12\nbad\n')
    assert files.read_lines(spark, str(tmp_path / "log"), files.ACCESS_LOG, ["host", "ident", "user", "time", "request", "status", "bytes"]).first()["status"] == "200"


def test_json_array_over_many_files(spark, tmp_path):
    import json

    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("],[ "), F.col("id"))).alias("s")).repartition(5)
    path = str(tmp_path / "array")
    files.export_json_array(df, path, [F.col("id").desc()])
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*"))))
    assert [x["id"] for x in whole] == list(range(499, -1, -1))
    assert whole[0] == {"id": 499, "s": "],[ 499"} and whole[1] == {"id": 498, "s": None}
    assert rows(files.import_json_array(spark, path, "id BIGINT, s STRING")) == rows(df)
    files.export_json_array(df.limit(0), path, [F.col("id")])
    assert rows(files.import_json_array(spark, path, "id BIGINT, s STRING")) == []


def test_table_function(spark):
    functions.register_table_function(spark, "upto", "n INT", lambda n: ((i,) for i in range(n)))
    assert rows(spark.sql("SELECT n FROM upto(3)")) == [(0,), (1,), (2,)]


class Numbers(functions.RestrictedSource):
    fields = {"n": "INT", "restricted": "INT", "asked": "STRING", "context": "STRING"}
    rows, rows_in_slice = 100, 50

    @classmethod
    def name(cls):
        return "numbers"

    def scan(self, number, of, restrictions, columns):
        for n in range(number, 100, of):
            if all(functions.satisfies(n, op, value) for column, op, value in restrictions if column == "n"):
                row = {"n": n, "restricted": len(restrictions), "asked": ",".join(columns), "context": self.options.get("context")}
                yield tuple(row[c] for c in columns)


def test_restrictions_reach_the_source(spark):
    from pyspark import cloudpickle as pickle

    pickle.register_pickle_by_value(__import__(Numbers.__module__))
    got = functions.load(spark, Numbers, context="here").filter("n >= 97").collect()
    assert sorted(r["n"] for r in got) == [97, 98, 99]
    assert all(r["restricted"] >= 1 and r["context"] == "here" for r in got)
    some = functions.load(spark, Numbers, ["asked", "n"])
    assert some.columns == ["asked", "n"] and {r["asked"] for r in some.collect()} == {"asked,n"}
    assert some.rdd.getNumPartitions() == 2
    assert "Broadcast" in spark.range(10**7).join(functions.load(spark, Numbers), F.col("id") == F.col("n"))._jdf.queryExecution().executedPlan().toString()


def test_explain(spark):
    df = spark.range(10).groupBy((F.col("id") % 2).alias("k")).count()
    assert "HashAggregate" in explain.operators(df)
    assert explain.analyze(df)[0] == 2


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.sql("SELECT TIMESTAMP '2020-01-01 00:10:00' AS ts, 'a' AS k, 1.0D AS v UNION ALL SELECT TIMESTAMP '2020-01-01 00:50:00', 'a', 2.0D UNION ALL SELECT TIMESTAMP '2020-01-01 01:10:00', 'a', 4.0D")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "ts", ["k"], "1 hour", "v", "10 minutes").writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["total"] for r in spark.table("tumbling").collect()) == [3.0, 4.0]
    assert windows.sessions(events, "ts", ["k"], "30 minutes").count() == 2


def test_search_without_a_limit(spark):
    from millrace.queries import own_sql
    from millrace.sources import search

    df = spark.range(50).selectExpr("id AS doc_id", "'a clown' AS text")
    out = search.search(df, "doc_id", "text", "clown", window=None)
    assert out.count() == 50
    assert "Limit" not in own_sql._search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_cursor(spark):
    from millrace.operators.cursor import Cursor

    c = Cursor(spark.range(10).select(F.col("id").alias("number"), (F.col("id") * 10).alias("v")).repartition(3), [F.col("number").desc()])
    assert [r["number"] for r in c.rows(2, 4).collect()] == [8, 7, 6]
    assert [c.next()[0], c.next()[0], c.last()[0], c.previous()[0], c.absolute(-10)[0], c.first()[0]] == [9, 8, 0, 1, 9, 9]
    assert c.previous() is None and c.at == 0
    assert c.absolute(11) is None and c.previous()["number"] == 0
    empty = Cursor(spark.range(0), [F.col("id")])
    assert empty.next() is None and empty.last() is None


def test_written_tables_can_be_deleted(spark):
    import os

    from millrace.operators import materialize as m

    one, two = m.materialize(spark.range(3), "one"), m.materialize(spark.range(4), "two")
    place = [df._written.removeprefix("file://") for df in (one, two)]
    assert all(map(os.path.exists, place)) and one.count() == 3
    m.discard(one, spark.range(1))
    assert [os.path.exists(p) for p in place] == [False, True]
    two.createOrReplaceTempView("kept")
    m._written[spark.sparkContext.applicationId] = {two._written}
    m.cleanup(spark)
    assert not os.path.exists(place[1])
