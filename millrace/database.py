"""Statements of the dialect over named tables: DDL, INSERT, UPDATE, DELETE, MERGE, CALL, EXPLAIN and queries.

A table is an immutable DataFrame; a change makes its new state with the operators
of `operators.dml`, writes it once, checks the constraints and puts it in place, so
readers of the old state are not disturbed.  Tables and views are Spark's temporary
views of the same names.  Each statement is a transaction of its own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalog
from .dialect import UnsupportedError, rewrite
from .operators import dml
from .operators.materialize import materialize
from .plans.explain import explain
from .typed import blanked

# Types of the dialect by Spark's names; TIME is text.
TYPES = {"SMALLINT": "SMALLINT", "INTEGER": "INT", "INT": "INT", "BIGINT": "BIGINT", "REAL": "FLOAT", "DOUBLE": "DOUBLE", "FLOAT": "DOUBLE", "BOOLEAN": "BOOLEAN", "DATE": "DATE", "TIME": "STRING", "TIMESTAMP": "TIMESTAMP_NTZ", "CHAR": "STRING", "CHARACTER": "STRING", "VARCHAR": "STRING", "LONG": "STRING", "CLOB": "STRING", "XML": "STRING", "BLOB": "BINARY", "DECIMAL": "DECIMAL", "NUMERIC": "DECIMAL"}


@dataclass
class Table:
    schema: T.StructType
    rows: DataFrame
    defaults: dict[str, str] = field(default_factory=dict)
    identity: dict[str, str] = field(default_factory=dict)
    not_null: list[str] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    unique: list[tuple[str, ...]] = field(default_factory=list)


def _name(text: str) -> str:
    return text.strip('"`').lower()


def _pieces(text: str, by: str = ",") -> list[str]:
    """Parts between separators outside of brackets and literals."""
    plain, depth, out, last = blanked(text), 0, [], 0
    for m in re.finditer(rf"[()]|{by}", plain, re.I):
        depth += (m[0] == "(") - (m[0] == ")")
        if not depth and m[0] not in "()":
            out.append(text[last : m.start()].strip())
            last = m.end()
    return [*out, text[last:].strip()]


def _brackets(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at `at`."""
    plain, depth = blanked(text), 0
    for k in range(at, len(text)):
        depth += (plain[k] == "(") - (plain[k] == ")")
        if not depth:
            return k + 1
    raise UnsupportedError("a bracket that is not closed")


def _type(text: str) -> T.DataType:
    """A type of the dialect; lengths are not kept, decimals have (5, 0) by default."""
    m = re.match(r"(\w+)(?:\s+PRECISION|\s+VARYING)?\s*(?:\(\s*(\w+)\s*(?:,\s*(\d+)\s*)?\))?(.*)", text.strip(), re.I | re.S)
    known = TYPES.get(m[1].upper())
    if known is None:
        raise UnsupportedError(f"type {text}")
    if re.search(r"\bFOR\s+BIT\s+DATA\b", text, re.I):
        known = "BINARY"
    if known == "DECIMAL":
        known = f"DECIMAL({m[2] or 5},{m[3] or 0})"
    return T._parse_datatype_string(known)


class Database:
    """Tables by name; `execute` takes one statement."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.references: list[dml.Reference] = []
        for name, rows in (tables or {}).items():
            self._place(name.lower(), Table(rows.schema, rows))

    def _place(self, name: str, table: Table) -> None:
        self.tables[name] = table
        table.rows.createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        return self._known(name).rows

    def _known(self, name: str) -> Table:
        if _name(name) not in self.tables:
            raise ValueError(f"no such table: {name}")
        return self.tables[_name(name)]

    def query(self, sql: str, parameters: Sequence = ()) -> DataFrame:
        return catalog.execute(self.spark, rewrite(sql, parameters))

    def execute(self, sql: str, parameters: Sequence = ()):
        """A query's rows, the number of rows that a change touched, or None."""
        sql = sql.strip().rstrip(";").strip()
        if parameters:
            sql = _with_values(sql, parameters)
        for pattern, run in _STATEMENTS:
            if m := re.match(pattern, sql, re.I | re.S):
                return run(self, sql, m)
        return self.query(sql)

    # ---- definitions

    def _create_table(self, sql: str, m: re.Match) -> None:
        name = _name(m[1])
        if name in self.tables:
            raise ValueError(f"table {name} exists")
        rest = sql[m.end() :].strip()
        if not rest.startswith("("):
            query = re.sub(r"\s+WITH\s+(NO\s+)?DATA\s*$", "", re.sub(r"^AS\s+", "", rest, flags=re.I), flags=re.I)
            rows = self.query(query)
            if re.search(r"\bWITH\s+NO\s+DATA\s*$", rest, re.I):
                rows = rows.limit(0)
            rows = materialize(rows, "table")
            self._place(name, Table(rows.schema, rows))
            return
        table, fields, references = Table(T.StructType([]), None), [], []
        for part in _pieces(rest[1 : _brackets(rest, 0) - 1]):
            part = re.sub(r"^CONSTRAINT\s+\S+\s+", "", part, flags=re.I)
            if k := re.match(r"(PRIMARY\s+KEY|UNIQUE)\s*\((.*)\)$", part, re.I | re.S):
                columns = tuple(map(_name, _pieces(k[2])))
                table.unique.append(columns)
                if k[1].upper().startswith("PRIMARY"):
                    table.not_null += columns
            elif k := re.match(r"CHECK\s*\((.*)\)$", part, re.I | re.S):
                table.checks.append(k[1])
            elif k := re.match(r"FOREIGN\s+KEY\s*\((.*?)\)\s*(REFERENCES\b.*)$", part, re.I | re.S):
                references.append((tuple(map(_name, _pieces(k[1]))), k[2]))
            else:
                fields.append(self._column(part, table, references))
        table.schema = T.StructType(fields)
        table.rows = self.spark.createDataFrame([], table.schema)
        self._place(name, table)
        for columns, text in references:
            k = re.match(r'REFERENCES\s+("?\w+"?)\s*(?:\((.*?)\))?\s*(?:ON\s+DELETE\s+(CASCADE|SET\s+NULL|RESTRICT|NO\s+ACTION))?', text, re.I | re.S)
            parent = self._known(k[1])
            to = tuple(map(_name, _pieces(k[2]))) if k[2] else parent.unique[0]
            action = " ".join((k[3] or "restrict").lower().split())
            self.references.append(dml.Reference(name, columns, _name(k[1]), to, "restrict" if action == "no action" else action))

    def _column(self, part: str, table: Table, references: list) -> T.StructField:
        m = re.match(r'("(?:[^"]|"")+"|\w+)\s+(.*)$', part, re.S)
        name, rest = _name(m[1]), m[2]
        clauses = r"\b(?:NOT\s+NULL|(?:WITH\s+)?DEFAULT|GENERATED|PRIMARY\s+KEY|UNIQUE|CHECK|REFERENCES|CONSTRAINT)\b"
        found = re.search(clauses, blanked(rest), re.I)
        kind, rest = (rest[: found.start()], rest[found.start() :]) if found else (rest, "")
        if re.search(r"\bNOT\s+NULL\b|\bPRIMARY\s+KEY\b", rest, re.I):
            table.not_null.append(name)
        if re.search(r"\bPRIMARY\s+KEY\b|\bUNIQUE\b", rest, re.I):
            table.unique.append((name,))
        if k := re.search(r"\bCHECK\s*\(", rest, re.I):
            table.checks.append(rest[k.end() : _brackets(rest, k.end() - 1) - 1])
        if k := re.search(r"\bREFERENCES\b.*$", rest, re.I | re.S):
            references.append(((name,), k[0]))
        if k := re.search(r"\bGENERATED\s+(?:ALWAYS|BY\s+DEFAULT)\s+AS\s+IDENTITY\s*(?:\(\s*(?:START\s+WITH\s+(-?\d+))?\s*,?\s*(?:INCREMENT\s+BY\s+(-?\d+))?\s*\))?", rest, re.I):
            table.identity[name] = f"identity_{id(table):x}_{name}"
            catalog.create_sequence(table.identity[name], int(k[1] or 1), int(k[2] or 1))
        elif k := re.search(r"\bDEFAULT\s+((?:'(?:[^']|'')*'|[^\s,()]+(?:\([^()]*\))?))", rest, re.I):
            table.defaults[name] = k[1]
        return T.StructField(name, _type(kind))

    def _drop_table(self, sql: str, m: re.Match) -> None:
        name = _name(m[1])
        self._known(name)
        if any(r.parent == name and r.child != name for r in self.references):
            raise dml.ConstraintError(f"other tables refer to {name}")
        self.references = [r for r in self.references if r.child != name]
        del self.tables[name]
        self.spark.catalog.dropTempView(name)

    def _create_view(self, sql: str, m: re.Match) -> None:
        view = self.query(sql[m.end() :])
        (view.toDF(*map(_name, _pieces(m[2]))) if m[2] else view).createOrReplaceTempView(_name(m[1]))

    def _drop_view(self, sql: str, m: re.Match) -> None:
        if not self.spark.catalog.dropTempView(_name(m[1])):
            raise ValueError(f"no such view: {m[1]}")

    def _create_sequence(self, sql: str, m: re.Match) -> None:
        number = lambda words: int(k[1]) if (k := re.search(rf"{words}\s+(-?\d+)", sql, re.I)) else 1
        catalog.create_sequence(_name(m[1]), number(r"START\s+WITH"), number(r"INCREMENT\s+BY"))

    # ---- changes

    def _change(self, name: str, rows: DataFrame, fresh: DataFrame | None = None) -> None:
        """Puts a new state in place if it keeps the constraints; only `fresh` rows are looked at where they alone can break one."""
        table = self.tables[name]
        look = rows if fresh is None else fresh
        for c in table.not_null:
            if not look.filter(F.col(f"`{c}`").isNull()).isEmpty():
                raise dml.ConstraintError(f"a null in {name}.{c}")
        for text in table.checks:
            if not dml.check(look, F.expr(rewrite(text))).isEmpty():
                raise dml.ConstraintError(f"CHECK ({text})")
        for columns in table.unique:
            names = [f"`{c}`" for c in columns]
            known = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in names))
            if not known.groupBy(*names).count().filter("count > 1").isEmpty():
                raise dml.ConstraintError(f"{name}: {', '.join(columns)} twice")
        for r in self.references:
            if r.child == name:
                parent = rows if r.parent == name else self.tables[r.parent].rows
                self._refers(look, r, parent)
        table.rows = rows
        self._place(name, table)

    def _refers(self, rows: DataFrame, r: dml.Reference, parent: DataFrame) -> None:
        own = rows.select(*(F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(r.columns))).dropna()
        keys = parent.select(*(F.col(f"`{c}`").alias(f"key{i}") for i, c in enumerate(r.parent_columns)))
        on = [F.col(f"own{i}") == F.col(f"key{i}") for i in range(len(r.columns))]
        if not own.join(keys, on, "left_anti").isEmpty():
            raise dml.ConstraintError(f"{r.child} refers to what is not in {r.parent}")

    def _insert(self, sql: str, m: re.Match) -> int:
        name, table = _name(m[1]), self._known(m[1])
        columns = [*map(_name, _pieces(m[2]))] if m[2] else table.schema.names
        source = sql[m.end() :].strip()
        if k := re.match(r"VALUES\b", source, re.I):
            rows = [self._values(columns, table, row) for row in _rows(source[k.end() :])]
            source = " UNION ALL ".join(f"SELECT {row}" for row in rows)
        found = self.query(source)
        if len(found.columns) != len(columns):
            raise ValueError(f"{len(columns)} columns, {len(found.columns)} values")
        found = found.toDF(*columns)
        for c, sequence in table.identity.items():
            if c not in columns:
                found.createOrReplaceTempView("millrace_inserted")
                found = catalog.execute(self.spark, f"SELECT *, NEXT VALUE FOR {sequence} AS `{c}` FROM millrace_inserted")
        defaults = {c: F.expr(rewrite(text)) for c, text in table.defaults.items()}
        fresh = materialize(dml.normalize(found, self.spark.createDataFrame([], table.schema), defaults), "inserted")
        n = fresh.count()
        self._change(name, table.rows.unionAll(fresh), fresh)
        return n

    @staticmethod
    def _values(columns: list[str], table: Table, row: str) -> str:
        """A row of VALUES with DEFAULT written out."""
        return ", ".join(table.defaults.get(c, "NULL") if v.upper() == "DEFAULT" else v for c, v in zip(columns, _pieces(row), strict=True))

    def _update(self, sql: str, m: re.Match) -> int:
        name, table = _name(m[1]), self._known(m[1])
        alias = m[2] or name
        rest = sql[m.end() :]
        where = re.search(r"\bWHERE\b", blanked(rest), re.I)
        condition = rest[where.end() :] if where else "TRUE"
        changes = dict((_name(a.split(".")[-1].strip()), b) for a, b in (part.split("=", 1) for part in _pieces(rest[: where.start()] if where else rest)))
        for c in changes:
            if c not in table.schema.names:
                raise ValueError(f"no such column: {c}")
        kinds = {f.name: f.dataType.simpleString() for f in table.schema}
        old = self.query(f"SELECT {alias}.*, ({condition}) AS millrace_hit{''.join(f', CAST({e.strip()} AS {kinds[c]}) AS millrace_new_{c}' for c, e in changes.items() if e.strip().upper() != 'DEFAULT')} FROM {name} AS {alias}")
        hit = F.coalesce("millrace_hit", F.lit(False))
        value = lambda c: F.expr(rewrite(table.defaults.get(c, "NULL"))) if changes[c].strip().upper() == "DEFAULT" else F.col(f"millrace_new_{c}")
        # New values of rows that stay are never looked at, so an error in them does not count.
        rows = materialize(old.select(*(F.when(hit, value(f.name)).otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) if f.name in changes else F.col(f"`{f.name}`") for f in table.schema), hit.alias("millrace_hit")), "updated")
        n = rows.filter("millrace_hit").count()
        for r in self.references:
            if r.parent == name and set(changes) & set(r.parent_columns):
                self._refers(rows if r.child == name else self.tables[r.child].rows, r, rows)
        self._change(name, rows.drop("millrace_hit"), rows.filter("millrace_hit").drop("millrace_hit"))
        return n

    def _delete(self, sql: str, m: re.Match) -> int:
        name, table = _name(m[1]), self._known(m[1])
        alias = m[2] or name
        rest = sql[m.end() :].strip()
        condition = re.sub(r"^WHERE\b", "", rest, flags=re.I) if rest else "TRUE"
        marked = materialize(self.query(f"SELECT {alias}.*, coalesce(({condition}), FALSE) AS millrace_hit FROM {name} AS {alias}"), "deleted")
        n = marked.filter("millrace_hit").count()
        states = {k: t.rows for k, t in self.tables.items() if any(k in (r.child, r.parent) for r in self.references)} | {name: marked}
        after = dml.delete_from(states, [r for r in self.references if r.child in states], name, F.col("millrace_hit"))
        for k, rows in after.items():
            if k == name or any(r.child == k for r in self.references):
                self._change(k, (rows.drop("millrace_hit") if k == name else rows).select(*(f"`{c}`" for c in self.tables[k].schema.names)))
        return n

    def _truncate(self, sql: str, m: re.Match) -> None:
        self._known(m[1])
        self._delete(f"DELETE FROM {m[1]}", re.match(_DELETE, f"DELETE FROM {m[1]}", re.I))

    def _merge(self, sql: str, m: re.Match) -> int:
        name, table = _name(m[1]), self._known(m[1])
        t, s = m[2] or name, m[4] or _name(m[3])
        source = self.spark.table(_name(m[3]))
        parts = _pieces(sql[m.end() :], r"\bWHEN\b")

        def expression(text: str) -> F.Column:
            text = re.sub(rf"\b{t}\s*\.\s*", "t.", text, flags=re.I)
            return F.expr(rewrite(re.sub(rf"\b{s}\s*\.\s*", "s.", text, flags=re.I)))

        clauses = []
        for part in parts[1:]:
            k = re.match(r"(NOT\s+)?MATCHED\s*(?:AND\b(.*?))?\bTHEN\s+(UPDATE\s+SET|DELETE|INSERT)\b(.*)$", part, re.I | re.S)
            when, action, rest = expression(k[2]) if k[2] else None, k[3].split()[0].upper(), k[4]
            if action == "DELETE":
                clauses.append(dml.When(True, None, when))
            elif action == "UPDATE":
                pairs = (p.split("=", 1) for p in _pieces(rest))
                clauses.append(dml.When(True, {_name(a.split(".")[-1].strip()): expression(e) for a, e in pairs}, when))
            else:
                k = re.match(r"\s*(?:\((.*?)\))?\s*VALUES\s*\((.*)\)\s*$", rest, re.I | re.S)
                columns = [*map(_name, _pieces(k[1]))] if k[1] else table.schema.names
                values = {c: F.expr(rewrite(x)) for c, x in table.defaults.items()} | {c: expression(e) for c, e in zip(columns, _pieces(k[2]), strict=True)}
                clauses.append(dml.When(False, values, when))
        rows = materialize(dml.merge_into(table.rows, source, expression(parts[0]), clauses), "merged")
        old = table.rows
        self._change(name, rows)
        return max(old.exceptAll(rows).count(), rows.exceptAll(old).count())

    def _call(self, sql: str, m: re.Match):
        return catalog.call(self.spark, sql)

    def _explain(self, sql: str, m: re.Match) -> str:
        return explain(self.query(sql[m.end() :]))


def _with_values(sql: str, parameters: Sequence) -> str:
    """The statement with its parameters' values in place of ?, otherwise unchanged."""
    from .dialect import literal

    plain, values, out, last = blanked(sql.replace('"', "`")), iter(parameters), [], 0
    marks = [k for k, c in enumerate(plain) if c == "?"]
    if len(marks) != len(parameters):
        raise ValueError(f"{len(marks)} parameters wanted, {len(parameters)} given")
    for k in marks:
        out += [sql[last:k], literal(next(values))]
        last = k + 1
    return "".join(out) + sql[last:]


def _rows(text: str) -> list[str]:
    """The rows of VALUES, without their brackets."""
    return [part[1:-1] if part.startswith("(") and _brackets(part, 0) == len(part) else part for part in _pieces(text)]


_TABLE = r'("(?:[^"]|"")+"|\w+)'
_DELETE = rf"DELETE\s+FROM\s+{_TABLE}(?:\s+(?:AS\s+)?(?!WHERE\b)(\w+))?(?=\s|$)"
_STATEMENTS = [
    (rf"CREATE\s+TABLE\s+{_TABLE}\s*", Database._create_table),
    (rf"DROP\s+TABLE\s+{_TABLE}\s*$", Database._drop_table),
    (rf"CREATE\s+VIEW\s+{_TABLE}\s*(?:\((.*?)\))?\s*AS\s+", Database._create_view),
    (rf"DROP\s+VIEW\s+{_TABLE}\s*$", Database._drop_view),
    (rf"CREATE\s+SEQUENCE\s+{_TABLE}", Database._create_sequence),
    (rf"DROP\s+SEQUENCE\s+{_TABLE}(?:\s+RESTRICT)?\s*$", lambda self, sql, m: catalog.drop_sequence(_name(m[1]))),
    (rf"INSERT\s+INTO\s+{_TABLE}\s*(?:\(((?!\s*SELECT\b).*?)\))?\s*(?=VALUES\b|SELECT\b|WITH\b|\()", Database._insert),
    (rf"UPDATE\s+{_TABLE}(?:\s+(?:AS\s+)?(?!SET\b)(\w+))?\s+SET\s+", Database._update),
    (_DELETE, Database._delete),
    (rf"TRUNCATE\s+TABLE\s+{_TABLE}\s*$", Database._truncate),
    (rf"MERGE\s+INTO\s+{_TABLE}(?:\s+(?:AS\s+)?(?!USING\b)(\w+))?\s+USING\s+{_TABLE}(?:\s+(?:AS\s+)?(?!ON\b)(\w+))?\s+ON\s+", Database._merge),
    (r"\{?\s*CALL\s+", Database._call),
    (r"EXPLAIN\s+", Database._explain),
]
