"""Changes of tables as DataFrames: the new state of the target is returned, and written by the caller.

Parquet tables have no changes in place; at scale the target is one input of a
join on its key, so that a change costs one pass and, where both sides are
bucketed by the key, no shuffle of the target.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialize import materialize
from .relational import free


class ConstraintError(ValueError):
    """A row violates a constraint."""


def normalize(rows: DataFrame, target: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rows in the target's columns and types, missing columns by default or null; casts fail rather than lose values (ANSI)."""
    defaults = defaults or {}
    have = set(rows.columns)
    return rows.select(*((F.col(f"`{f.name}`") if f.name in have else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in target.schema))


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    return target.unionAll(normalize(rows, target, defaults))


def update(target: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    """A null condition leaves the row as it is; all new values come from the old row."""
    hit = F.coalesce(where, F.lit(False))
    return target.select(*(F.when(hit, changes[f.name].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in changes else F.col(f"`{f.name}`") for f in target.schema))


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.filter(~F.coalesce(where, F.lit(False)))


def delete_keys(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return target.join(keys.select(*on).distinct(), on, "left_anti")


@dataclass(frozen=True)
class Reference:
    """A foreign key: columns of a child table that refer to columns of a parent; `action` on delete is cascade, set null or restrict."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    action: str = "restrict"


def delete_from(tables: dict[str, DataFrame], references: list[Reference], table: str, where: Column) -> dict[str, DataFrame]:
    """All tables after deleting rows of one, over any number of levels, also where tables refer to themselves or in a circle.

    Each round takes the rows that the last one deleted, and finds by a join on the
    key which rows of the children go with them; row numbers of what is gone are
    written, so a round costs what it deletes.  A null in a key refers to nothing.
    References with `restrict` are checked when all is done: a row that refers to a
    deleted one and stays is an error.
    """
    ids = {name: free(df, "row")[0] for name, df in tables.items()}
    rows = {name: materialize(df.withColumn(ids[name], F.monotonically_increasing_id()), "delete-rows") for name, df in tables.items()}
    dead: dict[str, DataFrame] = {}
    cleared: dict[Reference, DataFrame] = {}
    fresh = {table: rows[table].filter(F.coalesce(where, F.lit(False))).select(ids[table])}

    def referring(ref: Reference, gone: DataFrame) -> DataFrame:
        """Numbers of the child's rows that refer to the parent's rows with these numbers."""
        keys = rows[ref.parent].join(gone, ids[ref.parent], "left_semi").select(*(F.col(f"`{c}`").alias(f"key{i}") for i, c in enumerate(ref.parent_columns)))
        child = rows[ref.child].select(F.col(ids[ref.child]), *(F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(ref.columns)))
        return child.join(keys, reduce(lambda x, y: x & y, (F.col(f"own{i}") == F.col(f"key{i}") for i in range(len(ref.columns)))), "left_semi").select(ids[ref.child])

    def with_more(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if old is None else old.union(new)

    while fresh:
        fresh = {name: materialize(new, "delete-dead") for name, new in fresh.items()}
        fresh = {name: new for name, new in fresh.items() if not new.isEmpty()}
        for name, new in fresh.items():
            dead[name] = with_more(dead.get(name), new)
        found: dict[str, DataFrame] = {}
        for ref in references:
            if ref.parent in fresh and ref.action == "cascade":
                found[ref.child] = with_more(found.get(ref.child), referring(ref, fresh[ref.parent]))
            elif ref.parent in fresh and ref.action == "set null":
                cleared[ref] = with_more(cleared.get(ref), materialize(referring(ref, fresh[ref.parent]), "delete-cleared"))
        fresh = {name: new.distinct() if name not in dead else new.distinct().join(dead[name], ids[name], "left_anti") for name, new in found.items()}
    for ref in references:
        if ref.action == "restrict" and ref.parent in dead:
            left = referring(ref, dead[ref.parent])
            if not (left.join(dead[ref.child], ids[ref.child], "left_anti") if ref.child in dead else left).isEmpty():
                raise ConstraintError(f"rows of {ref.child} refer to what would be deleted from {ref.parent}")
    out = {}
    for name, df in tables.items():
        kept = rows[name].join(dead[name], ids[name], "left_anti") if name in dead else rows[name]
        for ref, gone in cleared.items():
            if ref.child == name:
                [hit] = free(kept, "hit")
                kept = kept.join(gone.distinct().withColumn(hit, F.lit(True)), ids[name], "left")
                kept = kept.withColumns({c: F.when(F.col(hit).isNull(), F.col(f"`{c}`")) for c in ref.columns}).drop(hit)
        out[name] = kept.select(*(F.col(f"`{c}`") for c in df.columns))
    return out


def delete_cascade(parent: DataFrame, gone: Column, child: DataFrame, parent_key: str, child_key: str, action: str = "cascade") -> tuple[DataFrame, DataFrame]:
    """(parent, child) after deleting parent rows; children go, have their key set to null, or forbid it (`restrict`)."""
    after = delete_from({"parent": parent, "child": child}, [Reference("child", (child_key,), "parent", (parent_key,), action)], "parent", gone)
    return after["parent"], after["child"]


@dataclass(frozen=True)
class When:
    """A clause of MERGE: `matched` or not, a condition, and the action: update or insert with values, or delete (no values)."""

    matched: bool
    values: dict[str, Column] | None = None
    condition: Column | None = None


def merge_into(target: DataFrame, source: DataFrame, on: Column, clauses: list[When]) -> DataFrame:
    """MERGE with any condition and any number of clauses; in expressions the target's columns are `t.x`, the source's `s.x`.

    For a pair of rows the first matched clause whose condition holds acts, for a
    source row without a pair the first other one.  A target row on which clauses
    act twice is an error, found while the rows are made.
    """
    t_id, s_id, action, value, times = free(target, *free(source, "t", "s", "action", "value", "times"))
    t = materialize(target.withColumn(t_id, F.monotonically_increasing_id()), "merge-target").alias("t")
    s = materialize(source.withColumn(s_id, F.monotonically_increasing_id()), "merge-source").alias("s")
    fields = target.schema.fields

    def chosen(matched: bool) -> Column:
        """The number of the clause that acts, or null."""
        out = F.lit(None).cast("int")
        for i, c in reversed(list(enumerate(clauses))):
            if c.matched == matched:
                out = F.when(F.lit(True) if c.condition is None else F.coalesce(c.condition, F.lit(False)), F.lit(i)).otherwise(out)
        return out

    def row(matched: bool) -> Column:
        """The target's new row by the clause that acts, or null."""
        out = F.lit(None).cast(target.schema)
        for i, c in enumerate(clauses):
            if c.matched == matched and c.values is not None:
                old = lambda f: F.col(f"t.`{f.name}`") if matched else F.lit(None)
                own = F.struct(*((c.values[f.name] if f.name in c.values else old(f)).cast(f.dataType).alias(f.name) for f in fields))
                out = F.when(F.col(action) == i, own).otherwise(out)
        return out

    pairs = t.join(s, on).withColumn(action, chosen(True))
    acted = pairs.filter(F.col(action).isNotNull()).select(t_id, row(True).alias(value))
    once = acted.groupBy(t_id).agg(F.count("*").alias(times), F.first(value).alias(value))
    twice = F.raise_error(F.lit("MERGE acts twice on a row of the target")).cast(target.schema)
    once = once.select(F.col(t_id), F.when(F.col(times) > 1, twice).otherwise(F.col(value)).alias(value), F.lit(True).alias(action))
    kept = t.join(once, t_id, "left").filter(F.col(action).isNull() | F.col(value).isNotNull())
    kept = kept.select(*(F.when(F.col(action), F.col(value)[f.name]).otherwise(F.col(f"t.`{f.name}`")).alias(f.name) for f in fields))
    if all(c.matched for c in clauses):
        return kept
    alone = s.join(pairs.select(s_id).distinct(), s_id, "left_anti").alias("s").withColumn(action, chosen(False)).filter(F.col(action).isNotNull())
    return kept.unionAll(alone.select(row(False).alias(value)).select(f"{value}.*"))


def merge(target: DataFrame, source: DataFrame, on: list[str], *, matched_update: dict[str, Column] | None = None, matched_delete: Column | None = None, insert_values: dict[str, Column] | None = None, insert_when: Column | None = None) -> DataFrame:
    """MERGE on equal columns: a matched row is deleted where matched_delete holds, else updated; a source row without a match is inserted where insert_when holds."""
    clauses = []
    if matched_delete is not None:
        clauses.append(When(True, None, matched_delete))
    if matched_update is not None:
        clauses.append(When(True, matched_update))
    if insert_values is not None:
        clauses.append(When(False, insert_values, insert_when))
    return merge_into(target, source, reduce(lambda a, b: a & b, (F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in on)), clauses)


def check_foreign_key(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is not null and not in the parent."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("__key")).distinct(), F.col(child_key) == F.col("__key"), "left_anti")


def check(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that violate a CHECK: a condition that is unknown does not."""
    return rows.filter(~F.coalesce(condition, F.lit(True)))


def generated(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """GENERATED ALWAYS AS columns."""
    return rows.withColumns(columns)


def identity(rows: DataFrame, name: str, start: int = 1, step: int = 1) -> DataFrame:
    """Unique numbers: start + step * k for distinct k, with gaps, and without a shuffle."""
    return rows.withColumn(name, F.lit(start) + F.lit(step) * F.monotonically_increasing_id())


def transitions(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Transition tables for triggers: (rows as they were, rows as they are) of all changed, removed and added rows."""
    return old.exceptAll(new), new.exceptAll(old)
