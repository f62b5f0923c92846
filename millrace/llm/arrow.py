"""Helpers for Arrow-batched operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch; executors hold several at once, in the JVM and in Python.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to BATCH_BYTES, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names; every other column, whatever its name, is left out.  The session's Arrow batches get small."""
    small_batches(df.sparkSession)
    return df.select(*(F.col(f"`{name}`").alias(alias) for alias, name in columns.items()))


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that no column of the table has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def give_back() -> None:
    """Returns freed memory to the system: idle Python workers live on beside busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable) -> Callable:
    """The function of mapInArrow, which gives memory back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def frugal_group(run: Callable) -> Callable:
    """The function of applyInArrow, which gives memory back after each group."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        out = run(key, table)
        give_back()
        return out

    def two(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(key, left, right)
        give_back()
        return out

    return two if run.__code__.co_argcount == 3 else one


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Pieces of at most so many rows, so that what Python holds of a batch stays small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def ddl(df: DataFrame, names: list[str]) -> str:
    """Columns of a table as a schema text."""
    return ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in names)


def strings(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]
