"""Rule checks as jobs: each gives one row (check, status, got, target); status is PASS, FAIL or, for soft ones, NOTE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result(df: DataFrame, name: str, got: Column, target: float, tolerance: float = 0.0, hard: bool = True) -> DataFrame:
    """One aggregate compared with its target."""
    value = F.coalesce(got.cast("double"), F.lit(0.0))
    status = F.when(F.abs(F.col("got") - target) <= tolerance, "PASS").otherwise("FAIL" if hard else "NOTE")
    return df.agg(value.alias("got")).select(F.lit(name).alias("check"), status.alias("status"), F.round("got", 6).alias("got"), F.lit(float(target)).alias("target"))


def violations(df: DataFrame, name: str, bad: Column, hard: bool = True) -> DataFrame:
    """Rows that break a rule; none may."""
    return result(df, name, F.count_if(F.coalesce(bad, F.lit(False))), 0, hard=hard)


def unique(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Keys that repeat."""
    return result(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), name, F.count_if(F.col("n") > 1), 0)


def foreign_key(df: DataFrame, parent: DataFrame, name: str, on: list[str]) -> DataFrame:
    """Rows without a parent."""
    return result(df.join(parent.select(*on).distinct(), on, "left_anti"), name, F.count(F.lit(1)), 0)


def complete(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Empty cells in columns that must have none."""
    return result(df, name, reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")) for c in columns]), 0)


def hygienic(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Cells with control characters or the traces of a wrong decoding."""
    bad = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F�]|Ã[\u0080-¿]|â€"
    return result(df, name, reduce(lambda a, b: a + b, [F.count_if(F.coalesce(F.col(c).rlike(bad), F.lit(False))) for c in columns]), 0)


def domain(df: DataFrame, name: str, column: str, allowed: list[str]) -> DataFrame:
    """Values outside the allowed set."""
    return violations(df, name, F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def cardinality(df: DataFrame, name: str, column: str, target: int) -> DataFrame:
    """Different values of a column; there must be so many."""
    return result(df, name, F.countDistinct(column), target)


def plain_numbers(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Cells of money that are no plain number: digits with at most one point and a minus."""
    bad = [F.count_if(F.coalesce(~F.col(c).cast("string").rlike(r"^-?\d+(\.\d+)?$"), F.lit(False))) for c in columns]
    return result(df, name, reduce(lambda a, b: a + b, bad), 0)


def one_instant(df: DataFrame, name: str, key: str, instant: str) -> DataFrame:
    """Keys whose rows have several instants."""
    return result(df.groupBy(key).agg(F.countDistinct(instant).alias("n")), name, F.count_if(F.col("n") > 1), 0)


def ranking(df: DataFrame, name: str, column: str, expected: list[str]) -> DataFrame:
    """Places at which the values, by falling count and then name, are not the expected ones."""
    from pyspark.sql import Window

    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), column)))
    return result(ranked, name, F.count_if((F.col("r") <= len(expected)) & (F.col(column) != F.element_at(F.array(*[F.lit(x) for x in expected]), F.least("r", F.lit(len(expected)))))), 0)


def tie_out(a: DataFrame, b: DataFrame, name: str, on: list[str], measure: str, tolerance: float) -> DataFrame:
    """Groups that one side lacks or whose measures differ by more than the tolerance."""
    side = lambda df, n: df.select(*on, F.col(measure).cast("double").alias(n), F.lit(True).alias(f"has_{n}"))
    both = side(a, "x").join(side(b, "y"), on, "full")
    wrong = F.col("has_x").isNull() | F.col("has_y").isNull() | (F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))) > tolerance)
    return result(both, name, F.count_if(wrong), 0)


def run_checks(checks: list[DataFrame], raise_on_failure: bool = False) -> DataFrame:
    """All results as one table; with raise_on_failure a FAIL stops the job that reads them."""
    out = reduce(lambda a, b: a.unionByName(b), checks)
    if raise_on_failure:
        out = out.withColumn("status", F.when(F.col("status") == "FAIL", F.raise_error(F.concat(F.lit("check failed: "), "check")).cast("string")).otherwise(F.col("status")))
    return out
