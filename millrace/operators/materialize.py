"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, in local runs only, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Computes the rows once: written to the shared folder and read from there, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_written", None):
            _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Deletes all that this application has written and not discarded: for the end, when no result is read any more."""
    for path in sorted(_written.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)
