"""Joins by time beyond a few versions a key: bucketed interval joins, as-of joins, and overlaps by a sweep.

Time is cut into buckets of `width` days. A window is laid into every bucket that it overlaps, clipped to the days that the
points span, so a point meets only the windows of its own bucket, a key of any size is dealt over its buckets, and a join
without a key is an equi-join on the bucket. No key is joined with itself as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def bucket_of(day: Column, width: int) -> Column:
    """The number of the bucket of a date."""
    return F.floor(F.unix_date(day) / width).cast("long")


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__k_{k}" for k in keys})


def join_intervals(points: DataFrame, windows: DataFrame, keys: list[str], day: str, lo: str, hi: str, width: int = 32, how: str = "inner") -> DataFrame:
    """Every point (date `day`) with every window of its keys that holds it, both ends included; how: inner or left.

    keys may be empty. An open end (null hi) lasts for ever, a null lo or an inverted window holds nothing; points with a
    null day or key match nothing. Columns of windows other than the keys must have names of their own.
    """
    span = points.agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    ends = _named(windows, keys).withColumn("__hi", F.coalesce(F.col(hi), F.lit(FOREVER).cast("date"))).crossJoin(F.broadcast(span))
    # what ends before the first point or begins after the last meets none
    met = ends.filter((F.col(lo) <= F.col("__hi")) & (F.col(lo) <= F.col("__b")) & (F.col("__hi") >= F.col("__a")))
    laid = met.withColumn("__bucket", F.explode(F.sequence(bucket_of(F.greatest(lo, "__a"), width), bucket_of(F.least("__hi", "__b"), width)))).drop("__a", "__b")
    placed = points.withColumn("__own", bucket_of(F.col(day), width))
    on = (F.col("__own") == F.col("__bucket")) & F.col(day).between(F.col(lo), F.col("__hi"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    return placed.join(laid, on, how).drop("__own", "__bucket", "__hi", *[f"__k_{k}" for k in keys])


def join_as_of(points: DataFrame, versions: DataFrame, keys: list[str], day: str, since: str, columns: list[str], width: int = 32) -> DataFrame:
    """Every point with `columns` of the last version of its keys that began on its day or before (null if there is none).

    Points and versions are merged in order within (keys, bucket), where the last version goes forward; what was in force
    when a bucket began comes from the last version of each earlier bucket, one row a bucket. versions has a (keys, since)
    once; of versions that repeat it the one with the greatest columns counts. Points with a null day have none.
    """
    value = F.struct(F.col(since).alias("__since"), *[F.col(c).alias(f"__v_{c}") for c in columns])
    told = versions.filter(F.col(since).isNotNull()).select(*keys, bucket_of(F.col(since), width).alias("__bucket"), F.col(since).alias("__day"), value.alias("__version"))
    held = told.groupBy(*keys, "__bucket").agg(F.max("__version").alias("__last"))
    marked = points.withColumns({"__bucket": bucket_of(F.col(day), width), "__day": F.col(day), "__point": F.lit(1)})
    # the buckets of points and versions, each with the last version of those before it
    buckets = held.unionByName(marked.filter(F.col(day).isNotNull()).select(*keys, "__bucket").distinct(), allowMissingColumns=True).groupBy(*keys, "__bucket").agg(F.max("__last").alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = buckets.select(*keys, "__bucket", F.lit(None).cast("date").alias("__day"), before.alias("__version")).filter("__version IS NOT NULL")
    merged = marked.unionByName(told.unionByName(carried).withColumn("__point", F.lit(0)), allowMissingColumns=True)
    up = Window.partitionBy(*keys, "__bucket").orderBy(F.col("__day").asc_nulls_first(), "__point", F.col("__version").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("__version", F.last("__version", ignorenulls=True).over(up)).filter("__point = 1")
    known = F.col("__day").isNotNull()
    return found.select(*points.columns, *[F.when(known, F.col(f"__version.__v_{c}")).alias(c) for c in columns])


def overlaps(windows: DataFrame, key: str, version: str, lo: str, hi: str) -> DataFrame:
    """Pairs (a_version < b_version) of one key whose windows overlap; an open end lasts for ever, an inverted window holds
    nothing.

    A sweep in order of beginnings keeps the greatest end so far: where a window begins after it, a new cluster begins, and
    only windows of one cluster are paired. Keys whose windows are apart make no pair at all.
    """
    ends = windows.select(F.col(key), F.col(version).alias("__id"), F.col(lo).alias("__lo"), F.coalesce(F.col(hi), F.lit(FOREVER).cast("date")).alias("__hi")).filter("__lo <= __hi")
    order = Window.partitionBy(key).orderBy("__lo", "__hi", "__id")
    reach = F.max("__hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    swept = ends.withColumn("__new", F.when(reach >= F.col("__lo"), 0).otherwise(1))
    clustered = swept.withColumn("__cluster", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(key, "__cluster"))
    several = clustered.withColumn("__size", size).filter("__size > 1")
    a, b = (several.select(F.col(key).alias(f"{p}_key"), F.col("__cluster").alias(f"{p}_cluster"), F.col("__id").alias(f"{p}_version"), F.col("__lo").alias(f"{p}_lo"), F.col("__hi").alias(f"{p}_hi")) for p in "ab")
    on = F.col("a_key").eqNullSafe(F.col("b_key")) & (F.col("a_cluster") == F.col("b_cluster")) & (F.col("a_version") < F.col("b_version")) & (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
    return a.join(b, on).select(F.col("a_key").alias(key), "a_version", "b_version")
