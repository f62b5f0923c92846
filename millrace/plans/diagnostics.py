"""Tables about tables and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import TABLES, table
from .explain import operators


def space(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """name, files, bytes and n_rows of each table; only the files' own facts and row counts are read."""
    out = None
    for name in names:
        files = table(spark, sf_dir, name).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.first("_metadata.file_size").alias("size"), F.count("*").alias("n"))
        one = files.agg(F.lit(name).alias("name"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select("name", "files", "bytes", "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


def columns(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """table, number (from 1), column, type and whether it may be null, from the schemas alone."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable) for name in names for i, f in enumerate(table(spark, sf_dir, name).schema, 1)]
    return spark.createDataFrame(rows, "`table` string, number int, `column` string, type string, nullable boolean")


def statement_plan(df: DataFrame) -> DataFrame:
    """The operators of a statement's plan, top first: place and operator."""
    return df.sparkSession.createDataFrame(list(enumerate(operators(df), 1)), "place int, operator string")
