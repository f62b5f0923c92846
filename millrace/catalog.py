"""Tables of a directory, as DataFrames and as views; queries of the dialect."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_AFTER_TABLES = "CROSS|EXCEPT|FULL|GROUP|HAVING|INNER|INTERSECT|JOIN|LATERAL|LEFT|LIMIT|NATURAL|OFFSET|ON|ORDER|RIGHT|TABLESAMPLE|UNION|USING|WHERE|WINDOW"


def run_sql(spark: SparkSession, sf_dir: str, sql: str, parameters: Sequence = ()) -> DataFrame:
    """A query in the engine's dialect over the directory's tables, written {name}, with values for its ?."""
    from .dialect import rewrite

    text = rewrite(sql, parameters)
    for t in TABLES:
        if "{" + t + "}" in text:
            view = f"millrace_{t}_{zlib.crc32(sf_dir.encode()):08x}"
            table(spark, sf_dir, t).createOrReplaceTempView(view)
            # Where the text gives no other name, the table's own one qualifies its columns.
            text = re.sub(rf"\{{{t}\}}(?=(\s+(?:AS\s+)?(?!(?:{_AFTER_TABLES})\b)[A-Za-z_`])?)", lambda m: view if m[1] else f"{view} AS {t}", text, flags=re.I)  # noqa: B023
    return execute(spark, text)


_NUMBERED = re.compile(r"(?:\bROW_NUMBER\s*\(\s*\)\s*OVER\s*\(\s*\)|\bNEXT\s+VALUE\s+FOR\s+(?P<sequence>\w+))(?:\s+(?:AS\s+)?(?!FROM\b|AS\b)(?P<name>\w+|`[^`]+`))?", re.I)
#: Sequences by lower-cased name: the next value and the step.
_sequences: dict[str, list[int]] = {}


def create_sequence(name: str, start: int = 1, step: int = 1) -> None:
    """A sequence for NEXT VALUE FOR, of this driver process."""
    if not step:
        raise ValueError("a sequence's step is not 0")
    _sequences[name.lower()] = [start, step]


def drop_sequence(name: str) -> None:
    del _sequences[name.lower()]


_procedures: dict[str, Callable] = {}


def create_procedure(name: str, run: Callable) -> None:
    """run(spark, *arguments) for CALL name(...); it may return a DataFrame."""
    _procedures[name.lower()] = run


def register_function(spark: SparkSession, name: str, returns: str, run: Callable) -> None:
    """A scalar function for SQL text; run takes and gives pandas series, a batch at a time."""
    spark.udf.register(name, F.pandas_udf(run, returns))


def call(spark: SparkSession, sql: str, parameters: Sequence = ()) -> DataFrame | None:
    """CALL name(arguments): constant expressions, computed by Spark."""
    from .dialect import rewrite

    m = re.fullmatch(r"\s*\{?\s*CALL\s+(\w+)\s*\((.*)\)\s*\}?\s*;?\s*", rewrite(sql, parameters), re.I | re.S)
    if not m or m[1].lower() not in _procedures:
        raise ValueError(f"no such procedure: {sql}")
    arguments = list(spark.sql(f"SELECT {m[2]}").first()) if m[2].strip() else []
    return _procedures[m[1].lower()](spark, *arguments)


def execute(spark: SparkSession, text: str) -> DataFrame:
    """Spark SQL with the dialect's types, and with ROW_NUMBER() OVER () and NEXT VALUE FOR: each block that has one is numbered in parallel, and read as a view."""
    from .operators.relational import numbered
    from .typed import blanked, typed

    count = 0
    while m := _NUMBERED.search(blanked(text)):
        m = _NUMBERED.match(text, m.start())
        plain, a, b, depth = blanked(text), 0, len(text), 0
        for k in range(m.start() - 1, -1, -1):
            depth += (plain[k] == ")") - (plain[k] == "(")
            if depth < 0:
                a = k + 1
                break
        depth = 0
        for k in range(m.end(), len(text)):
            depth += (plain[k] == "(") - (plain[k] == ")")
            if depth < 0:
                b = k
                break
        name = (m["name"] or "`row_number`").strip("`")
        block = f"{text[a : m.start()]}CAST(0 AS BIGINT) AS `{name}`{text[m.end() : b]}"
        rows = spark.sql(typed(spark, block))
        out = numbered(rows.drop(name), name, []).select(*(f"`{c}`" for c in rows.columns))
        if m["sequence"]:
            if m["sequence"].lower() not in _sequences:
                raise ValueError(f"no such sequence: {m['sequence']}")
            sequence = _sequences[m["sequence"].lower()]
            start, step = sequence
            sequence[0] += step * out.count()
            out = out.withColumn(name, F.lit(start).cast("bigint") + F.lit(step) * (F.col(f"`{name}`") - 1))
        if (a, b) == (0, len(text)):
            return out.orderBy(name) if re.search(r"\bORDER\s+BY\b", blanked(block), re.I) else out
        count += 1
        view = f"millrace_numbered_{id(out):x}_{count}"
        out.createOrReplaceTempView(view)
        text = f"{text[:a]}SELECT * FROM {view}{text[b:]}"
    return spark.sql(typed(spark, text))
