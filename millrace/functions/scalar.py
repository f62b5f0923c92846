"""Scalar functions whose meaning differs from Spark's own, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division: truncates towards zero; a zero divisor is an error (ANSI mode)."""
    return F.call_function("div", a, b)


def int_avg(x: Column) -> Column:
    """AVG of integers: truncates; null without values."""
    total, n = F.sum(x), F.count(x)
    return F.when(n > 0, int_div(total, F.nullif(n, F.lit(0))))


def int_sum(x: Column) -> Column:
    """SUM of INTEGER in INTEGER: overflow is an error."""
    return F.sum(x).cast("int")


def nulls_high(x: Column, ascending: bool = True) -> Column:
    """Sort key with nulls above all values."""
    return x.asc_nulls_last() if ascending else x.desc_nulls_first()


def char_equal(a: Column, b: Column) -> Column:
    """Comparison of CHAR values: trailing blanks do not matter."""
    return F.rtrim(a) == F.rtrim(b)


def char_pad(x: Column, n: int) -> Column:
    """CHAR(n): padded; longer values are an error unless only blanks are lost."""
    return F.when(F.length(F.rtrim(x)) > n, F.raise_error(F.concat(F.lit(f"value too long for CHAR({n}): "), x))).otherwise(F.rpad(F.substring(x, 1, n), n, " "))


#: LENGTH by type: bytes of fixed-size values, digits of decimals, characters of strings.
FIXED_LENGTHS = {"smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 10, "timestamp_ntz": 10, "boolean": 1}


def length_of(x: Column, kind: str) -> Column:
    if kind.startswith("decimal"):
        precision = int(kind[8:].split(",")[0])
        return F.when(x.isNotNull(), precision // 2 + 1)
    if kind in FIXED_LENGTHS:
        return F.when(x.isNotNull(), FIXED_LENGTHS[kind])
    return F.length(x)


def date_of_number(n: Column) -> Column:
    """DATE(n): day 1 is 1970-01-01."""
    return F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int") - 1)


def time_text(x: Column) -> Column:
    """TIME values are held as HH:mm:ss."""
    return F.date_format(x, "HH:mm:ss")


def timestamp_of(date: Column, time: Column) -> Column:
    return F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), time).cast("timestamp_ntz")


def quantified(x: Column, op: str, low: Column, high: Column, n: Column, n_null: Column, every: bool) -> Column:
    """x op ALL/ANY of a set known by its least and largest value, its size and its number of nulls; three-valued.

    ALL over an empty set is true, ANY is false; a null in the set or in x leaves what the rest does not settle unknown.
    """
    if op in ("=", "<>"):
        # For = ALL and <> ANY the least and the largest value say all; the others are IN and NOT IN.
        if every != (op == "="):
            raise ValueError("= ANY is IN, <> ALL is NOT IN: see relational.not_in")
        test = (x == low) & (x == high) if every else (x != low) | (x != high)
        return _quantified(test, x, n, n_null, every)
    worst = {"<": low, "<=": low, ">": high, ">=": high}[op] if every else {"<": high, "<=": high, ">": low, ">=": low}[op]
    test = {"<": x < worst, "<=": x <= worst, ">": x > worst, ">=": x >= worst}[op]
    return _quantified(test, x, n, n_null, every)


def _quantified(test: Column, x: Column, n: Column, n_null: Column, every: bool) -> Column:
    none = F.lit(None).cast("boolean")
    if every:
        return F.when(n + n_null == 0, True).when((n > 0) & ~test, False).when((n_null > 0) | x.isNull(), none).otherwise(test)
    return F.when(n + n_null == 0, False).when((n > 0) & test, True).when((n_null > 0) | x.isNull(), none).otherwise(test)
