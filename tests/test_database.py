import datetime
import decimal

import pytest

from millrace.database import Database
from millrace.operators import dml


@pytest.fixture
def db(spark):
    db = Database(spark)
    db.execute("CREATE TABLE unit (id INT NOT NULL PRIMARY KEY, name VARCHAR(20) DEFAULT 'none', budget DECIMAL(10,2) CHECK (budget >= 0))")
    db.execute("CREATE TABLE staff (name VARCHAR(30) NOT NULL, unit INT REFERENCES unit(id) ON DELETE CASCADE, points INTEGER, since DATE, CONSTRAINT one UNIQUE (name))")
    assert db.execute("INSERT INTO unit VALUES (1, 'it''s, one', 10.5), (2, DEFAULT, NULL)") == 2
    assert db.execute("INSERT INTO unit (id, budget) VALUES (3, 7)") == 1
    assert db.execute("INSERT INTO staff VALUES ('a', 1, 7, DATE '2020-01-02'), ('b', 2, 8, NULL), ('c', NULL, NULL, CAST(? AS DATE))", ["2021-05-06"]) == 3
    return db


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tables(db):
    assert rows(db.execute("SELECT * FROM unit")) == [(1, "it's, one", decimal.Decimal("10.50")), (2, "none", None), (3, "none", decimal.Decimal("7.00"))]
    assert dict(db.table("staff").dtypes) == {"name": "string", "unit": "int", "points": "int", "since": "date"}
    db.execute("CREATE TABLE copy AS SELECT name, points / 2 AS half FROM staff WITH DATA")
    assert rows(db.table("copy")) == [("a", 3), ("b", 4), ("c", None)]
    db.execute("DROP TABLE copy")
    with pytest.raises(ValueError):
        db.table("copy")
    with pytest.raises(dml.ConstraintError):
        db.execute("DROP TABLE unit")


def test_update(db):
    assert db.execute("UPDATE staff SET points = points / 2 + ?, since = DATE '2000-01-01' WHERE unit IN (SELECT id FROM unit WHERE name LIKE '%one' OR name = 'none')", [100]) == 2
    day = datetime.date(2000, 1, 1)
    assert rows(db.table("staff")) == [("a", 1, 103, day), ("b", 2, 104, day), ("c", None, None, datetime.date(2021, 5, 6))]
    assert db.execute("UPDATE unit AS u SET name = DEFAULT WHERE u.id = 1") == 1
    assert db.execute("UPDATE unit SET budget = 1") == 3
    for bad in ("UPDATE staff SET name = NULL", "UPDATE staff SET name = 'x'", "UPDATE staff SET unit = 9", "UPDATE unit SET budget = -1 WHERE id = 2", "UPDATE unit SET id = id + 50"):
        with pytest.raises(dml.ConstraintError):
            db.execute(bad)
    assert rows(db.execute("SELECT budget FROM unit")) == [(decimal.Decimal("1.00"),)] * 3


def test_delete(db):
    assert db.execute("DELETE FROM unit WHERE id = 1") == 1
    assert rows(db.execute("SELECT name FROM staff")) == [("b",), ("c",)]
    assert db.execute("DELETE FROM staff s WHERE s.unit IS NULL") == 1
    db.execute("TRUNCATE TABLE unit")
    assert db.execute("SELECT count(*) AS n FROM staff").first()["n"] == 0


def test_insert_checks(db):
    for bad in ("INSERT INTO unit VALUES (1, 'x', 1)", "INSERT INTO unit VALUES (9, 'x', -1)", "INSERT INTO staff (unit) VALUES (1)", "INSERT INTO staff (name, unit) VALUES ('z', 77)"):
        with pytest.raises(dml.ConstraintError):
            db.execute(bad)
    assert db.execute("INSERT INTO unit (id, name) SELECT id + 10, name FROM unit WHERE id > 1") == 2
    assert rows(db.execute("SELECT id FROM unit")) == [(1,), (11 + 1,), (13,), (2,), (3,)]


def test_merge(db):
    db.execute("CREATE TABLE news (id INT, name VARCHAR(20), cost INT)")
    db.execute("INSERT INTO news VALUES (1, 'new', 5), (2, 'gone', 6), (8, 'eight', 7), (9, 'nine', NULL)")
    n = db.execute("MERGE INTO unit AS u USING news n ON u.id = n.id WHEN MATCHED THEN UPDATE SET name = n.name, budget = n.cost * 2 WHEN NOT MATCHED AND n.cost IS NOT NULL THEN INSERT (id, budget) VALUES (n.id, n.cost)")
    assert n == 3
    assert rows(db.table("unit")) == [(1, "new", decimal.Decimal("10.00")), (2, "gone", decimal.Decimal("12.00")), (3, "none", decimal.Decimal("7.00")), (8, "none", decimal.Decimal("7.00"))]


def test_identity_sequences_views_and_calls(db):
    from millrace.catalog import create_procedure

    db.execute("CREATE TABLE log (id BIGINT GENERATED ALWAYS AS IDENTITY (START WITH 10, INCREMENT BY 5), what VARCHAR(9))")
    db.execute("INSERT INTO log (what) VALUES ('x'), ('y')")
    db.execute("INSERT INTO log (what) VALUES ('z')")
    assert [r[0] for r in rows(db.execute("SELECT id FROM log"))] == [10, 15, 20]
    db.execute("CREATE SEQUENCE numbers AS BIGINT START WITH 3 INCREMENT BY -1")
    assert [db.execute("VALUES NEXT VALUE FOR numbers").first()[0] for _ in range(2)] == [3, 2]
    db.execute("DROP SEQUENCE numbers RESTRICT")
    db.execute('CREATE VIEW big (k, "The Name") AS SELECT id, name FROM unit WHERE id > 1')
    assert rows(db.execute("SELECT k FROM big")) == [(2,), (3,)]
    db.execute("DROP VIEW big")
    create_procedure("add_units", lambda spark, n: db.execute("INSERT INTO unit (id) VALUES (?)", [n]))
    assert db.execute("CALL add_units(40 + 2)") == 1
    assert db.execute("SELECT count(*) AS n FROM unit WHERE id = 42").first()["n"] == 1
    assert "Scan" in db.execute("EXPLAIN SELECT * FROM unit") or "LocalTable" in db.execute("EXPLAIN SELECT * FROM unit")


def test_references_to_the_own_table(spark):
    db = Database(spark)
    db.execute("CREATE TABLE tree (id INT PRIMARY KEY, up INT REFERENCES tree(id) ON DELETE CASCADE, near INT REFERENCES tree ON DELETE SET NULL)")
    db.execute("INSERT INTO tree VALUES (1, NULL, NULL), (2, 1, 1), (3, 2, NULL), (4, NULL, 3), (5, 4, 4)")
    db.execute("DELETE FROM tree WHERE id = 2")
    assert rows(db.table("tree")) == [(1, None, None), (4, None, None), (5, 4, 4)]
