"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import discard, materialize


#: Rows of one node are dealt to so many tasks; adaptive execution splits them further.
SALTS = 16


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node of links(a bigint, b bigint).

    Alternates large-star and small-star steps until nothing changes, which takes
    few rounds whatever the shape.  A node's links are only reduced to a minimum
    with map-side combining, and meet that minimum in many tasks, so a hub with very
    many links is no hot key.  Each round is written to the shared folder, and the
    round before is deleted.
    """
    spark = links.sparkSession
    links = materialize(_oriented(links), "links")
    state = _state(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _oriented(_with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, least).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        before, links = links, materialize(_oriented(small), "links")
        discard(before)
        now = _state(links)
        if now == state:
            break
        state = now
    if not state[0]:
        discard(links)
        return spark.createDataFrame([], "node bigint, label bigint")
    roots = links.select(F.col("b").alias("node")).distinct()
    out = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select("node", F.col("node").alias("label"))), "labels")
    discard(links)
    return out


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each link with its node's minimum m."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["a", "salt"])


def _oriented(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller; no loops."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
