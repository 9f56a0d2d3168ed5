"""Delimited text in and out: all cells text with source row numbers, structural rows of hand-kept sheets, tokens for nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_text_table(spark: SparkSession, path: str, columns: list[str], sep: str = ",", line_breaks: bool = False) -> DataFrame:
    """All cells as text, empty cells kept; `_row` is the row of the sheet, its header being 1.

    Rows are numbered in the order of file names and of places in a file: every split's rows are counted, and each split
    starts where the ones before end. line_breaks: cells may hold quoted line breaks; a file is then one split. An empty
    file or folder gives no row; a row with too few cells gets empty ones.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    raw = spark.read.schema(schema).option("sep", sep).option("header", True).option("multiLine", line_breaks).option("nullValue", "\u0000").option("emptyValue", "").option("escape", '"').csv(path)
    split = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at")]
    numbered = raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns], *split, F.monotonically_increasing_id().alias("__id"))
    sizes = numbered.groupBy("__file", "__at").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__file", "__at", (before - F.col("__first")).alias("__start"))
    return numbered.join(starts, ["__file", "__at"]).withColumn("_row", F.col("__start") + F.col("__id") + 2).select(*columns, "_row")


def write_text_table(df: DataFrame, path: str, sep: str = ",", tokens: dict[str, str] | None = None, order: str | None = None) -> None:
    """Cells as text, nulls as their column's token (empty if it has none), whole numbers without `.0`."""
    types = dict(df.dtypes)

    def cell(c: str) -> Column:
        text = F.regexp_replace(F.col(c).cast("string"), r"\.0$", "") if types[c] in ("double", "float") else F.col(c).cast("string")
        return F.coalesce(text, F.lit((tokens or {}).get(c, ""))).alias(c)

    out = df.orderBy(order) if order else df
    out.select(*[cell(c) for c in df.columns]).write.option("sep", sep).option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("escape", '"').csv(path)


def load_clean(df: DataFrame, tokens: tuple[str, ...], types: dict[str, str]) -> DataFrame:
    """Tokens and empty cells become null, columns get their types; what does not fit its type becomes null."""
    out = df.withColumns({c: F.when(~F.col(c).isin("", *tokens), F.col(c)) for c in df.columns if c != "_row"})
    return out.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def split_structural_rows(df: DataFrame, rules: list[tuple[Column, str]], is_data: Column) -> tuple[DataFrame, DataFrame]:
    """Data rows, and the others with the reason of the first rule that holds, `unexplained` if none does."""
    reason = F.coalesce(*[F.when(c, n) for c, n in rules], F.when(~F.coalesce(is_data, F.lit(False)), F.lit("unexplained")))
    told = df.withColumn("_reason", reason)
    return told.filter("_reason IS NULL").drop("_reason"), told.filter("_reason IS NOT NULL")


def check_blocks(df: DataFrame, by: str, order: str, marker: str, month: str, size: int = 100_000) -> DataFrame:
    """Data rows that do not belong to the month of the next subtotal below them (rows below the last one belong to none).
    marker: the subtotal's month, null on data rows; order: a number.

    Sheets are cut into pieces of `size` in `order`; a task orders one piece, and what follows a piece is looked up in the
    first marker of each later one, so no task holds a sheet.
    """
    piece = F.floor(F.col(order) / size)
    below = Window.partitionBy(by, "__piece").orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    cut = df.withColumn("__piece", piece)
    firsts = cut.groupBy(by, "__piece").agg(F.min_by(marker, F.when(F.col(marker).isNotNull(), F.col(order))).alias("__marker"))
    after = F.first("__marker", ignorenulls=True).over(Window.partitionBy(by).orderBy("__piece").rowsBetween(1, Window.unboundedFollowing))
    later = firsts.select(by, "__piece", after.alias("__later"))
    told = cut.withColumn("__inside", F.first(marker, ignorenulls=True).over(below)).join(later, [by, "__piece"])
    return told.withColumn("block", F.coalesce("__inside", "__later")).filter(F.col(marker).isNull() & ~F.col("block").eqNullSafe(F.col(month))).drop("__piece", "__inside", "__later")
