"""Table functions: Python UDTFs, and sources that take columns and restrictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.functions import udtf

def register_table_function(spark: SparkSession, name: str, returns: str, rows: Callable[..., Iterator[tuple]]) -> None:
    """Makes rows(*args) usable as TABLE(name(args)) with the declared columns."""

    class Function:
        def eval(self, *args):
            yield from rows(*args)

    spark.udtf.register(name, udtf(Function, returnType=returns))

@dataclass
class Slice(InputPartition):
    number: int
    of: int

class RestrictedSource(DataSource):
    """A source over scan(slice, slices, restrictions, columns): simple restrictions come as (column, operator, value), and the columns wanted by name.

    Subclasses define name, fields (column to type) and scan, which yields tuples of
    the wanted columns; what scan does not apply itself is filtered by Spark.
    `rows` estimates how many rows there are: it decides how many slices are read,
    and whether `load` offers the source for a broadcast.  Other options of `load`
    are in `self.options`, so that a source may know what it is read for.
    """

    fields: dict[str, str] = {}
    rows: int | None = None
    rows_in_slice = 1_000_000
    handled: tuple[str, ...] = ("=", "<", "<=", ">", ">=", "in", "is null", "is not null")

    def scan(self, number: int, of: int, restrictions: list[tuple[str, str, object]], columns: list[str]) -> Iterator[tuple]:
        raise NotImplementedError

    def columns(self) -> list[str]:
        return self.options["columns"].split("\x1f") if "columns" in self.options else list(self.fields)

    def slices(self) -> int:
        return max(1, -(-(self.rows or 1) // self.rows_in_slice))

    def schema(self) -> str:
        return ", ".join(f"`{c}` {self.fields[c]}" for c in self.columns())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)


#: A source of so many rows at most is offered for a broadcast.
BROADCAST_ROWS = 100_000


def load(spark: SparkSession, source: type[RestrictedSource], columns: list[str] | None = None, **options: str) -> DataFrame:
    """The source's rows, with only the named columns asked of it.  Turns on, for the session, that filters go to Python sources: readers with restrictions need it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).options(**options)
    out = (reader.option("columns", "\x1f".join(columns)) if columns else reader).load()
    return F.broadcast(out) if source.rows is not None and source.rows <= BROADCAST_ROWS else out


_OPERATORS = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", In: "in", IsNull: "is null", IsNotNull: "is not null"}

class _Reader(DataSourceReader):
    def __init__(self, source: RestrictedSource):
        self.source = source
        self.restrictions: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            op = _OPERATORS.get(type(f))
            if op in self.source.handled and len(f.attribute) == 1:
                self.restrictions.append((f.attribute[0], op, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Slice]:
        of = self.source.slices()
        return [Slice(i, of) for i in range(of)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        yield from self.source.scan(partition.number, partition.of, self.restrictions, self.source.columns())

def satisfies(value: object, op: str, other: object) -> bool:
    """Whether a value meets a restriction; null meets none but IS NULL."""
    if op == "is null":
        return value is None
    if value is None:
        return False
    return {"=": lambda: value == other, "<": lambda: value < other, "<=": lambda: value <= other, ">": lambda: value > other, ">=": lambda: value >= other, "in": lambda: value in other, "is not null": lambda: True}[op]()

__all__ = ["BROADCAST_ROWS", "RestrictedSource", "Slice", "load", "register_table_function", "satisfies"]
