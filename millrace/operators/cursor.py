"""A result that can be read from any place: the rows are numbered and written once, and a fetch reads only its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialize import materialize
from .relational import free, numbered


class Cursor:
    """Scrolls over the rows in an order, and does not see later changes.  Positions count from 1; 0 is before the first row, below 0 counts from the end."""

    def __init__(self, df: DataFrame, order: list[Column]):
        self.columns = df.columns
        [self.number] = free(df, "number")
        rows = numbered(df, self.number, order)
        # Sorted by number, so that a fetch skips files and row groups by their statistics.
        self.table = materialize(rows.repartitionByRange(self.number).sortWithinPartitions(self.number), "cursor")
        self.size = self.table.agg(F.coalesce(F.max(self.number), F.lit(0))).first()[0]
        self.at = 0

    def rows(self, first: int, last: int) -> DataFrame:
        """Rows first to last, both included, in order."""
        n = F.col(self.number)
        return self.table.filter((n >= first) & (n <= last)).orderBy(n).select(*(F.col(f"`{c}`") for c in self.columns))

    def absolute(self, place: int):
        """The row at a place, or None outside of the rows, where the cursor then stands."""
        place = place if place >= 0 else self.size + 1 + place
        self.at = min(max(place, 0), self.size + 1)
        return self.rows(self.at, self.at).first() if 1 <= self.at <= self.size else None

    def relative(self, step: int):
        return self.absolute(max(0, self.at + step))

    def first(self):
        return self.absolute(1)

    def last(self):
        return self.absolute(self.size)

    def next(self):
        return self.relative(1)

    def previous(self):
        return self.relative(-1)

    def delete_current(self, target: DataFrame, keys: list[str]) -> DataFrame:
        """The target without the rows of the cursor's row, by its key."""
        return target.join(self.rows(self.at, self.at).select(*keys), keys, "left_anti")

    def update_current(self, target: DataFrame, keys: list[str], changes: dict[str, Column]) -> DataFrame:
        """The target with changed values in the rows of the cursor's row, by its key."""
        [hit] = free(target, "hit")
        marked = target.join(F.broadcast(self.rows(self.at, self.at).select(*keys).withColumn(hit, F.lit(True))), keys, "left")  # one row
        return marked.select(*((F.when(F.col(hit), changes[f.name]).otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) if f.name in changes else F.col(f"`{f.name}`")) for f in target.schema))
