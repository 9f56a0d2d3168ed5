"""Manifests: what was stored, told by numbers that do not depend on the order of rows, and checked when it is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import table

NAME = "_manifest"
SCHEMA = "table string, n_rows long, hash_sum decimal(38,0), hash_xor long"


def digest(df: DataFrame) -> list[Column]:
    """Rows, sum and exclusive or of the rows' 64-bit hashes over all columns in the order of their names (maps as JSON); 0, 0
    and 0 for an empty table. A changed, lost or repeated row changes the sum or the number, whatever the order."""
    plain = [F.to_json(f"`{c}`") if t.startswith("map") else F.col(f"`{c}`") for c, t in sorted(df.dtypes)]
    # a null leaves a hash as it is, so which cells are null is hashed too
    row = F.xxhash64(*plain, *[c.isNull() for c in plain])
    # the sum by three parts of a hash, so that rows are added up as longs (enough for 2 ** 41 rows)
    part, big = F.lit(2**21 - 1), lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("decimal(20,0)")
    shifted = lambda x, by: x * F.lit(2**by).cast("decimal(14,0)")
    total = shifted(big(F.shiftright(row, 42)), 42) + shifted(big(F.shiftright(row, 21).bitwiseAND(part)), 21) + big(row.bitwiseAND(part))
    return [F.count(F.lit(1)).alias("n_rows"), total.cast("decimal(38,0)").alias("hash_sum"), F.coalesce(F.bit_xor(row), F.lit(0)).cast("long").alias("hash_xor")]


def save_with_manifest(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under its name, and a table of their digests, which are counted while the rows are written."""
    told, spark = [], None
    for name, df in tables.items():
        spark, seen = df.sparkSession, Observation()
        df.observe(seen, *digest(df)).write.parquet(f"{folder}/{name}.parquet")
        found = seen.get
        told.append((name, found["n_rows"], found["hash_sum"], found["hash_xor"]))
    if spark is not None:
        spark.createDataFrame(told, SCHEMA).coalesce(1).write.parquet(f"{folder}/{NAME}.parquet")


def check_manifest(spark: SparkSession, folder: str, manifest: str | None = None, names: set[str] | None = None) -> DataFrame:
    """(table, n_rows, is_intact) of the tables that the manifest names; n_rows are those found. manifest: the folder of the
    manifest, if it is another one. names: these tables only."""
    told = table(spark, manifest or folder, NAME)
    parts = []
    for name in sorted(r["table"] for r in told.select("table").collect() if names is None or r["table"] in names):
        df = table(spark, folder, name)
        parts.append(df.agg(*digest(df)).withColumn("table", F.lit(name)))
    found = reduce(lambda a, b: a.unionByName(b), parts)
    then = told.withColumnsRenamed({c: f"then_{c}" for c in ("n_rows", "hash_sum", "hash_xor")})
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"then_{c}") for c in ("n_rows", "hash_sum", "hash_xor")])
    return found.join(F.broadcast(then), "table").select("table", "n_rows", same.alias("is_intact"))
