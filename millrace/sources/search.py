"""Text search over a column: rows by tf-idf score, with windowed paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize


def occurrences(text: str, term: str) -> F.Column:
    """How often a lower-cased word of letters and digits stands in a column; a term with other characters is no word."""
    if not term.isalnum():
        return F.lit(0)
    low = F.lower(F.col(f"`{text}`"))
    return F.when(low.contains(term), F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}]){term}(?![\p{{L}}\p{{N}}])"))).otherwise(0)


def search(df: DataFrame, key: str, text: str, query: str, *, start: int = 0, window: int | None = 10) -> DataFrame:
    """key and score of the rows that hold a query term, best first, ties by key: rows start to start + window, or to the end if window is None.

    One pass over the texts, which are looked at closely only if they hold a term;
    what is found is written and scored when the counts are known.  Nothing is
    shuffled but one count a term and the top rows.
    """
    wanted = sorted(set(query.lower().split()))
    names = [f"n{i}" for i in range(len(wanted))]
    if not wanted:
        return df.select(F.col(f"`{key}`").alias(key), F.lit(0.0).alias("score")).limit(0)
    counts = df.select(F.col(f"`{key}`").alias(key), *(F.coalesce(occurrences(text, t), F.lit(0)).alias(n) for t, n in zip(wanted, names, strict=True)))
    found = materialize(counts.filter(sum((F.col(n) for n in names), F.lit(0)) > 0), "search")
    total, of = df.count(), found.agg(*(F.count_if(F.col(n) > 0).alias(n) for n in names)).first()
    score = sum((F.sqrt(F.col(n).cast("double")) * F.log(F.lit((1 + total) / (1 + of[n]))) for n in names), F.lit(0.0))
    out = found.select(F.col(f"`{key}`").alias(key), F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.col(f"`{key}`")).offset(start)
    return out if window is None else out.limit(window)
