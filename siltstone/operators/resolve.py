"""Entity resolution: merging rows of a key, matching copies that got a new key, applying merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.conform import folded
from siltstone.operators.split import rejected


def merge_by_key(df: DataFrame, key: str, order: str, first: list[str], earliest: list[str], common: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row per key: first non-null by `order`, earliest value, most common value (ties to the first row), and the
    columns in which rows disagree; and the rows that were merged away. Nulls are no values and no disagreement; a null
    key is a key; which of rows that agree in `order` is the first is not defined; an empty table gives empty ones."""
    value = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    conflicts = F.array_compact(F.array(*[F.when(F.countDistinct(c) > 1, c) for c in [*first, *common]]))
    merged = df.groupBy(key).agg(*[value(c).alias(c) for c in first], *[F.min(c).alias(c) for c in earliest], F.array_join(conflicts, ",").alias("conflicts"), F.count(F.lit(1)).alias("n_rows"))
    for c in common:
        per = df.filter(F.col(c).isNotNull()).groupBy(key, c).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
        best = per.groupBy(key).agg(F.min_by(c, F.struct(-F.col("__n"), F.col("__first"))).alias(c))
        merged = merged.join(best, key, "left")
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return merged, rejected(df.withColumn("__n", n).filter("__n > 1").drop("__n"), "merged")


def common_letters(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts: for each letter of one, a row of lengths over the other."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def next_row(row: Column, x: Column) -> Column:
        # row[j]: greatest length with the first j letters of b; `left` is what this row has so far
        def step(left: Column, y: Column) -> Column:
            j = F.size(left)
            longer = F.when(x == y, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(left, -1), F.element_at(row, j + 1)))
            return F.concat(left, F.array(longer))

        return F.aggregate(letters(b), F.array(F.lit(0)), step)

    last = F.aggregate(letters(a), F.array_repeat(F.lit(0), F.length(b) + 1), next_row)
    return F.element_at(last, -1)


def similarity(a: Column, b: Column) -> Column:
    """Twice the letters that two texts have in common in one order, over the letters of both; 1 for two empty texts, null if
    one is null."""
    both = F.length(a) + F.length(b)
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(2 * common_letters(a, b) / both)


def match_rekeyed(df: DataFrame, key: str, offset: int, name: str, email: str, threshold: float) -> DataFrame:
    """Pairs (high, low) whose keys differ by `offset`: similarity of folded names, whether e-mails conflict, whether the
    pair holds. The similarity is computed for these pairs only."""
    side = lambda p: df.select(F.col(key).alias(p), folded(F.col(name)).alias(f"{p}_name"), F.col(email).alias(f"{p}_email"))
    pairs = side("high").filter(F.col("high") >= offset).withColumn("low", F.col("high") - offset).join(side("low"), "low")
    score = similarity(F.col("high_name"), F.col("low_name"))
    conflict = F.coalesce(F.col("high_email") != F.col("low_email"), F.lit(False))
    return pairs.withColumn("similarity", score).withColumn("email_conflict", conflict).select("high", "low", "similarity", "email_conflict", ((F.col("similarity") >= threshold) & ~conflict).alias("holds"))


def shortened(text: Column, deletions: int) -> Column:
    """Every text that up to `deletions` deletions of a letter leave of a text, itself first."""
    # the letters of a text before `to` may still be deleted, so each choice of places is made once
    start = F.array(F.struct(text.alias("t"), (F.length(text) + 1).alias("to")))
    places = lambda x: F.when(x["to"] > 1, F.sequence(F.lit(1), x["to"] - 1)).otherwise(F.array().cast("array<int>"))
    less = lambda x: F.transform(places(x), lambda i: F.struct(F.concat(F.substring(x["t"], F.lit(1), i - 1), F.substring(x["t"], i + 1, F.length(x["t"]))).alias("t"), i.alias("to")))
    level, found = start, [start]
    for _ in range(deletions):
        level = F.flatten(F.transform(level, less))
        found.append(level)
    return F.when(text.isNotNull(), F.array_distinct(F.transform(F.concat(*found), lambda x: x["t"])))


def best_match_evidence(df: DataFrame, pairs: DataFrame, key: str, name: str, edits: int = 2) -> DataFrame:
    """Whether each pair's low key is the one best match of the high key's name among all other names within `edits`.

    Two names within `edits` have a text in common that at most so many deletions leave of each. Names meet by hashes of
    these texts, and only names that meet are compared: no match is lost, and a name meets few others, however many share
    a beginning. Names that several keys have are compared once. Null names match nothing; pairs without a match are not in
    the result.
    """
    named = df.select(F.col(key).alias("k"), folded(F.col(name)).alias("n")).filter("n IS NOT NULL")
    # names are small and what is made of them is not: a set number of parts is not put together by their size
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = named.repartition(parts, "n").groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    wanted = pairs.select("high", "low").join(named.withColumnsRenamed({"k": "high", "n": "hn"}), "high")
    met = lambda df, n, *more: df.select(n, *more, F.explode(F.transform(shortened(F.col(n), edits), lambda x: F.xxhash64(x))).alias("h"))
    # the texts that are left are many times the names, which a broadcast by the size of the names does not see
    near = met(wanted.select("hn").repartition(parts, "hn").distinct(), "hn").hint("merge").join(met(names, "n", "c"), "h").filter("n <> hn").select("hn", "n", "c", F.levenshtein("hn", "n", edits).alias("d")).filter("d >= 0").distinct()
    others = near.groupBy("hn").agg(*[F.sum(F.when(F.col("d") == i, F.col("c")).otherwise(0)).alias(f"d{i}") for i in range(1, edits + 1)])
    same = names.select(F.col("n").alias("hn"), (F.col("c") - 1).alias("d0"))
    told = wanted.join(same, "hn").join(others, "hn", "left").join(named.select(F.col("k").alias("low"), F.col("n").alias("ln")), "low", "left")
    best = F.coalesce(*[F.when(F.col(f"d{i}") > 0, F.struct(F.lit(i).alias("d"), F.col(f"d{i}").alias("ties"))) for i in range(edits + 1)])
    found = told.withColumn("best", best).filter("best IS NOT NULL")
    return found.groupBy("high", "low").agg(F.max("best.ties").alias("ties"), F.bool_or(F.coalesce(F.levenshtein("hn", "ln", edits) == F.col("best.d"), F.lit(False))).alias("is_best"))


def apply_merges(df: DataFrame, pairs: DataFrame, key: str, fill: list[str], earliest: list[str]) -> DataFrame:
    """Survivors (low) with their gaps filled from the merged rows, earliest dates, `merged_from`, and the least similarity of
    their pairs as `merge_confidence`."""
    high = df.join(pairs.select(F.col("high").alias(key), "low", F.col("similarity").alias("__similarity")), key).groupBy("low").agg(
        F.array_sort(F.collect_list(key)).alias("merged_from"), F.min("__similarity").alias("merge_confidence"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(f"__{c}") for c in fill], *[F.min(c).alias(f"__{c}") for c in earliest]
    )
    stay = df.join(pairs.select(F.col("high").alias(key)), key, "left_anti").join(high.withColumnRenamed("low", key), key, "left")
    stay = stay.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in fill} | {c: F.least(F.col(c), F.col(f"__{c}")) for c in earliest})
    return stay.drop(*[f"__{c}" for c in [*fill, *earliest]])


def remap(df: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """References to merged keys become the survivors'."""
    to = pairs.select(F.col("high").alias(column), F.col("low").alias("__low"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("__low", column)).drop("__low")


def shared_attribute_groups(df: DataFrame, attribute: str, others: list[str]) -> DataFrame:
    """Values that several rows share, and how many values (null is one) the other columns have among these."""
    distinct = lambda c: (F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"n_{c}")
    return df.filter(F.col(attribute).isNotNull()).groupBy(attribute).agg(F.count(F.lit(1)).alias("n"), *[distinct(c) for c in others]).filter("n > 1")


def check_id_block(df: DataFrame, key: str, offset: int) -> DataFrame:
    """Low ids: least, greatest, number, gaps; high ids (from offset on): number, and those without a twin."""
    low, high = df.filter(F.col(key) < offset), df.filter(F.col(key) >= offset)
    a = low.agg(F.min(key).alias("low_min"), F.max(key).alias("low_max"), F.countDistinct(key).alias("low_ids")).withColumn("gaps", F.col("low_max") - F.col("low_min") + 1 - F.col("low_ids"))
    twins = high.select((F.col(key) - offset).alias("t")).distinct()
    b = twins.agg(F.count(F.lit(1)).alias("high_ids"))
    c = twins.join(low.select(F.col(key).alias("t")), "t", "left_anti").agg(F.count(F.lit(1)).alias("without_twin"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


def canonical_label(df: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Per key the most common spelling in mixed case; others only if none is mixed; ties to the first row."""
    mixed = (F.col(column) != F.upper(column)) & (F.col(column) != F.lower(column))
    per = df.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    return per.groupBy(key).agg(F.min_by(column, F.struct(F.when(mixed, 0).otherwise(1), -F.col("n"), F.col("o"))).alias(column))
