"""Relational operators whose semantics need more than one Spark call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize


class CardinalityError(ValueError):
    """A scalar subquery has more than one row."""


def paged(df: DataFrame, order: list[Column], offset: int | None = 0, fetch: int | None = None) -> DataFrame:
    """OFFSET and FETCH: an offset below 0, a fetch below 1, and null are errors; no fetch is no limit."""
    if offset is None or offset < 0:
        raise ValueError(f"OFFSET {offset}")
    if fetch is not None and fetch < 1:
        raise ValueError(f"FETCH FIRST {fetch}")
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(fetch) if fetch is not None else out


def numbered(df: DataFrame, name: str, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """ROW_NUMBER().  With partitions a window; over the whole table in steps that all run in parallel.

    Rows are dealt by range and sorted (without an order they stay as they are),
    and written once with their range and place, as a range's bounds are drawn
    anew whenever it is computed again.  Each range's size is added up (one row a
    range), and every row's number is its place plus what comes before.
    """
    if partition:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("bigint"))
    place, at, before, size = free(df, "place", "range", "before", "size")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    dealt = materialize(dealt.withColumn(place, F.monotonically_increasing_id()), "numbered").withColumn(at, F.shiftright(place, 33))
    # One row a range, as many as the step before had tasks.
    sizes = dealt.groupBy(at).agg(F.count("*").alias(size))
    starts = sizes.select(at, (F.sum(size).over(Window.orderBy(at)) - F.col(size)).alias(before))
    local = F.col(place).bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(starts), at).select(*(F.col(f"`{c}`") for c in df.columns), (F.col(before) + local + 1).alias(name))


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = "__" + name
        while name in taken:
            name += "_"
        out.append(name)
    return out


def once(subquery: DataFrame) -> Column:
    """A scalar subquery's value: null without rows, an error with more than one."""
    rows = subquery.limit(2).collect()
    if len(rows) > 1:
        raise CardinalityError("scalar subquery with more than one row")
    field = subquery.schema[0]
    return F.lit(rows[0][0] if rows else None).cast(field.dataType)


def intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """Nulls equal each other; ALL keeps the smaller of both numbers of a row."""
    return a.intersectAll(b) if all else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.exceptAll(b) if all else a.subtract(b)


def not_in(df: DataFrame, x: str, values: DataFrame) -> DataFrame:
    """x NOT IN (values), three-valued: nothing if a value is null; null x only if there are no values."""
    column = values.columns[0]
    state = values.agg(F.count("*").alias("n"), F.count(column).alias("known")).first()
    if not state["n"]:
        return df
    if state["n"] > state["known"]:
        return df.limit(0)
    return df.filter(F.col(x).isNotNull()).join(values.select(F.col(column).alias("__v")).distinct(), F.col(x) == F.col("__v"), "left_anti")


def range_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float, fan: int = 8) -> DataFrame:
    """left.at between right.low and right.high, by cells: an equi-join, in place of comparing all pairs.

    Cells are `width` wide on level 0 and `fan` times as wide on each further one.
    An interval is dealt to the lowest level on which it meets at most fan + 1
    cells, so a wide one makes no more rows than a narrow one; a point is looked up
    on the levels that intervals have.
    """
    level, cell, levels = free(left, *free(right, "level", "cell", "levels"))
    span = F.greatest(F.lit(1.0), (F.col(high) - F.col(low)) / width)
    placed = right.filter(F.col(low) <= F.col(high)).withColumn(level, F.greatest(F.lit(0), F.ceil(F.log(float(fan), span) - 1)).cast("int"))
    size = lambda at_level: F.lit(float(width)) * F.pow(F.lit(float(fan)), at_level)
    cells = placed.withColumn(cell, F.explode(F.sequence(F.floor(F.col(low) / size(F.col(level))), F.floor(F.col(high) / size(F.col(level))))))
    used = placed.agg(F.sort_array(F.collect_set(level)).alias(levels))  # a few numbers: logarithms of widths
    points = left.join(F.broadcast(used)).withColumn(level, F.explode(levels)).drop(levels).withColumn(cell, F.floor(F.col(at) / size(F.col(level))))
    return points.join(cells, [level, cell]).filter(F.col(at).between(F.col(low), F.col(high))).drop(level, cell)
