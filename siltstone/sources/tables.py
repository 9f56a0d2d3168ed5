"""Reading the named Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of `sf_dir`, a file or a folder, on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every Parquet table of a folder by name (but for those that begin with _), on any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = sorted(x.getPath().getName() for x in found)
    return {n.removesuffix(".parquet"): table(spark, folder, n.removesuffix(".parquet")) for n in names if n.endswith(".parquet") and not n.startswith("_")}


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under its name."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
