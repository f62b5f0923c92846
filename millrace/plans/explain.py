"""EXPLAIN and EXPLAIN ANALYZE."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def operators(df: DataFrame) -> list[str]:
    """Names of the physical operators, top first, without expression numbers: stable between runs."""
    return re.findall(r"^[ :|+\-]*(?:\*\(\d+\) )?([A-Z][A-Za-z]+)", df._jdf.queryExecution().executedPlan().toString(), re.M)


def explain_json(df: DataFrame) -> str:
    return json.dumps({"operators": operators(df), "logical": df._jdf.queryExecution().optimizedPlan().toString()})


def analyze(df: DataFrame) -> tuple[int, float, str]:
    """(rows, seconds, plan): runs the query to its end and throws the rows away where they are."""
    seen = Observation()
    began = time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"], time.perf_counter() - began, explain(df)
