"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing names."""

from pyspark.sql import functions as F

LONG = "word1 word2 other " * 6000
TEXTS = [(1, "Hello World again and again"), (2, None), (3, ""), (4, " \t\n "), (5, "Hello World again and again"), (5, "Hello World again and again"), (6, LONG), (None, "hello world AGAIN and again"), (7, "a\x00b é 日本 𝒳 <s>"), (8, "x" * 30000)]
DDL = "doc_id BIGINT, text STRING"


def documents(spark, rows=TEXTS):
    """With columns named like those the operators make."""
    df = spark.createDataFrame(rows, DDL)
    clashing = ("score", "ids", "n_tokens", "component", "rid", "th", "label", "node", "block", "cid", "held_out", "id", "s", "u", "hits", "base", "spans", "__hits", "__score", "__by_sum", "__by_length", "__base", "__spans", "__key", "__hash", "__kept_key", "__th", "__id", "__many")
    return df.withColumns({c: F.lit("x") for c in clashing} | {"source": F.lit(None).cast("string")})


def empty(spark):
    return documents(spark).limit(0)
