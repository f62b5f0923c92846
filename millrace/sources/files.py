"""Delimited, JSON, XML and plain-text sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.materialize import materialize
from ..operators.relational import free, numbered


def export_delimited(df: DataFrame, path: str, *, column: str = ",", quote: str = '"', codeset: str = "UTF-8", null: str = r"\N", lob_path: str | None = None, lobs: tuple[str, ...] = ()) -> None:
    """Writes character-delimited files, nulls as `null`; LOB columns go to a table of their own, with their place in the file."""
    if lobs:
        [row] = free(df, "row")
        # Written once: both files must have the same numbers.
        keyed = materialize(df.withColumn(row, F.monotonically_increasing_id()), "export")
        keyed.select(F.col(row).alias("row"), *(F.col(f"`{name}`") for name in lobs)).write.mode("overwrite").parquet(lob_path)
        df = keyed.select(*(F.concat(F.lit(f"{name}."), F.col(row).cast("string")).alias(name) if name in lobs else F.col(f"`{name}`") for name in df.columns))
    df.write.mode("overwrite").options(sep=column, quote=quote, escape=quote, encoding=codeset, emptyValue=quote * 2, nullValue=null).csv(path)


def import_delimited(spark: SparkSession, path: str, schema: T.StructType | str, *, column: str = ",", quote: str = '"', codeset: str = "UTF-8", null: str = r"\N", columns: list[int] | None = None, lob_path: str | None = None, lobs: tuple[str, ...] = ()) -> DataFrame:
    """Reads character-delimited files with a declared schema; `columns` picks fields by number, from 1."""
    df = spark.read.options(sep=column, quote=quote, escape=quote, encoding=codeset, mode="FAILFAST", emptyValue="", nullValue=null).schema(schema).csv(path)
    if lobs:
        names = df.columns
        [row] = free(df, "row")
        kept = spark.read.parquet(lob_path).withColumnRenamed("row", row)
        number = F.substring_index(F.col(f"`{lobs[0]}`"), ".", -1).cast("bigint")
        df = df.withColumn(row, number).drop(*lobs).join(kept, row).select(*(F.col(f"`{name}`") for name in names))
    return df.select(*(df.columns[i - 1] for i in columns)) if columns else df


def string_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of strings, coerced to a declared schema; text that does not fit is an error."""
    return df.select(*(F.col(f"`{name}`").cast(f.dataType).alias(f.name) for name, f in zip(df.columns, schema, strict=True)))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects; columns by key, absent keys null."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def json_array(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Rows of the JSON array in a column."""
    return df.select(F.explode(F.from_json(F.col(text), f"array<struct<{schema}>>")).alias("__x")).select("__x.*")


def export_json_array(df: DataFrame, path: str, order: list[Column]) -> None:
    """The table as one JSON array, nulls included: lines in files that make the array when put together in order of their names.

    Every task writes its own rows; none holds the table.
    """
    number, total = free(df, "number", "total")
    rows = numbered(df, number, order)
    last = rows.agg(F.max(number).alias(total))
    text = F.concat(F.when(F.col(number) == 1, "[").otherwise(","), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}), F.when(F.col(number) == F.col(total), "]").otherwise(""))
    lines = rows.join(F.broadcast(last)).select(number, text.alias("value"))  # one row
    if df.isEmpty():
        lines = df.sparkSession.sql("SELECT 1L AS n, '[]' AS value").toDF(number, "value")
    lines.repartitionByRange(number).sortWithinPartitions(number).select("value").write.mode("overwrite").text(path)


def import_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an array whose objects are on lines of their own, read line by line; columns by key, absent keys null."""
    line = F.regexp_replace("value", r"^\s*[\[,]\s*|\s*[\],]\s*$", "")
    return spark.read.text(path).select(line.alias("value")).filter("value <> ''").select(F.from_json("value", schema).alias("x")).select("x.*")


# Fixed value: the common log format.
ACCESS_LOG = r'^(\S+) (\S+) (\S+) \[([^\]]*)\] "([^"]*)" (\d{3}) (\S+)'


def read_lines(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Lines that match a pattern, one column a group; others are left out."""
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return lines.select(*(F.regexp_extract("value", pattern, i).alias(n) for i, n in enumerate(names, 1)))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """key and value of `key = value` lines; comments and blank lines are left out."""
    return read_lines(spark, path, r"^\s*([^#!=:\s][^=:\s]*)\s*[=:]\s*(.*)$", ["key", "value"])


def foreign_table(spark: SparkSession, url: str, name: str, properties: dict[str, str] | None = None, *, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table of another database by JDBC: filters and columns are pushed down, and a numeric key deals the reads."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **(properties or {}))
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def foreign_views(spark: SparkSession, url: str, names: list[str], schema: str = "", properties: dict[str, str] | None = None) -> None:
    """One temporary view for each foreign table."""
    for name in names:
        foreign_table(spark, url, f"{schema}.{name}" if schema else name, properties).createOrReplaceTempView(name)
