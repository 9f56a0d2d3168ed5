"""Column functions that several plans share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_number(day: Column) -> Column:
    """Days since 1970-01-01."""
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def quarter(day: str | Column) -> Column:
    """2024Q1."""
    day = F.col(day) if isinstance(day, str) else day
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def num(x: Column, digits: int = 2) -> Column:
    """A decimal or double result as a double rounded to `digits`."""
    return F.round(x.cast("double"), digits)


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b as a rounded double; null where b is 0 or null."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def chi_square_tail(x: Column, df: Column) -> Column:
    """The probability of a chi-square value of at least x with df (a positive whole number) degrees of freedom: one less the
    series of the lower incomplete gamma function. Null where x or df is null or df is not positive."""
    a, z = df / 2, x.cast("double") / 2
    # the logarithm of gamma(a + 1), down from a to 1 or 1/2
    factors = F.transform(F.sequence(F.lit(1), F.floor((df + 1) / 2).cast("int")), lambda i: F.log(a - i + 1))
    log_gamma = F.aggregate(factors, F.lit(0.0), lambda s, v: s + v) + F.when(df % 2 == 1, F.log(F.sqrt(F.pi()))).otherwise(0.0)
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    grown = lambda s, i: F.struct((s["term"] * z / (a + i)).alias("term"), (s["sum"] + s["term"] * z / (a + i)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), (F.ceil(2 * z) + 100).cast("int")), first, grown, lambda s: s["sum"])
    lower = F.exp(-z + a * F.log(z) - log_gamma) * series
    return F.when((df > 0) & (z > 0), F.greatest(F.lit(0.0), 1 - lower)).when((df > 0) & (z == 0), 1.0)
