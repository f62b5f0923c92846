"""User-defined aggregates, and aggregates with the dialect's result types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Aggregate:
    """A user-defined aggregate over partial states.

    `init` gives the columns of a state from one row, `merge` the column that
    combines the states of a group (by built-in aggregates, so partial
    aggregation applies), `finish` the result.
    """

    def __init__(self, init, merge, finish):
        self.init, self.merge, self.finish = init, merge, finish

    def over(self, df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
        state = df.select(*keys, *(c.alias(n) for n, c in self.init(F.col(x)).items()))
        merged = state.groupBy(*keys).agg(*(c.alias(n) for n, c in self.merge().items()))
        return merged.select(*keys, self.finish().alias(name))


#: Geometric mean of positive values.
GEOMETRIC_MEAN = Aggregate(
    lambda x: {"_n": F.when(x > 0, 1).otherwise(0), "_log": F.when(x > 0, F.log(x)).otherwise(0.0)},
    lambda: {"_n": F.sum("_n"), "_log": F.sum("_log")},
    lambda: F.when(F.col("_n") > 0, F.exp(F.col("_log") / F.col("_n"))),
)


def mode(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """The most frequent value of each group, the smallest of ties: counts are shuffled, never the rows."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(x).alias("x")))["x"]
    return counts.groupBy(*keys).agg(best.alias(name))
