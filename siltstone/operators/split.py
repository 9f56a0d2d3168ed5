"""Splitting tables into rows that stay and rows that go, with reasons; repairs from related rows; row accounting.

A rejected row carries `_reason`, `_detail` and, once quarantined, its payload as JSON. Row order is a column that the
caller names, never the order of partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rejected(df: DataFrame, reason: str, detail: Column | None = None) -> DataFrame:
    """`df` with its reason and detail."""
    return df.withColumns({"_reason": F.lit(reason), "_detail": (detail if detail is not None else F.lit(None)).cast("string")})


def quarantine(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rejected rows in the one shape of the quarantine: src_table, reason, detail, payload (JSON of `columns`, nulls written
    out). One row for each row, repeated ones too; an empty table gives an empty one."""
    payload = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.select(F.lit(name).alias("src_table"), F.col("_reason").alias("reason"), F.col("_detail").alias("detail"), payload.alias("payload"))


#: Rows of a group that one task may rank; ranges of the first order column that larger groups are dealt to.
GROUP_ROWS, RANGES = 100_000, 64


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], prefix: str) -> Column:
    """The condition that a's keys equal b's, which have the prefix; nulls are equal."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{prefix}{k}"]) for k in keys])


def with_group(df: DataFrame, keys: list[str], stats: list[Column], having: str | None = None) -> DataFrame:
    """`df` with aggregates of each row's group, null where `having` does not hold. Groups are added up before anything is
    shuffled, and the join's hot keys are left to adaptive execution, which splits their rows over tasks."""
    per = df.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys]).agg(*stats)
    per = per.filter(having) if having else per
    return df.join(per, same_keys(df, per, keys, "__g_"), "left").drop(*[f"__g_{k}" for k in keys])


def split_exact_duplicates(df: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """First row of equal keys (nulls are equal) by `order`, a row number that no two rows share, and the others with the row
    that they copy."""
    told = with_group(df, keys, [F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first")], "__n > 1")
    copies = F.coalesce(F.col(order) != F.col("__first"), F.lit(False))
    kept = told.filter(~copies).drop("__n", "__first")
    gone = rejected(told.filter(copies), "exact duplicate", F.concat(F.lit("copy of "), F.col("__first").cast("string")))
    return kept, gone.drop("__n", "__first")


def split_content_duplicates(df: DataFrame, content: list[str], soft: str, order: str) -> tuple[DataFrame, DataFrame]:
    """As exact duplicates on `content`; where copies differ in `soft` (null is a value), the kept row's `soft` becomes null
    and is flagged."""
    stats = [F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"), F.count(soft).alias("__known"), F.min(soft).alias("__least"), F.max(soft).alias("__most")]
    told = with_group(df, content, stats, "__n > 1")
    differs = F.coalesce((F.col("__least") != F.col("__most")) | ((F.col("__known") > 0) & (F.col("__known") < F.col("__n"))), F.lit(False))
    copies = F.coalesce(F.col(order) != F.col("__first"), F.lit(False))
    told = told.withColumns({"__differs": differs, "__copy": copies}).drop("__n", "__first", "__known", "__least", "__most")
    kept = told.filter("NOT __copy").withColumn(soft, F.when(~F.col("__differs"), F.col(soft))).withColumn("soft_conflict", F.col("__differs"))
    gone = told.filter("__copy").withColumn("_reason", F.when(F.col("__differs"), f"duplicate but for {soft}").otherwise("duplicate"))
    return kept.drop("__copy", "__differs"), gone.withColumn("_detail", F.lit(None).cast("string")).drop("__copy", "__differs")


def ordinal(df: DataFrame, column: str) -> Column:
    """A double that never falls where the column rises: numbers and days themselves, of texts the first six bytes."""
    kind = dict(df.dtypes)[column]
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.unix_date(column).cast("double") if kind == "date" else F.col(column).cast("double")


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """`out`: the place of each row in its group by `order` (nulls first), from 1; which of rows that agree in it comes first
    is not defined.

    A group of more than GROUP_ROWS rows is dealt to RANGES ranges of its first order column by approximate quantiles; ranges
    are ranked in tasks of their own and start where the ones before them end. Rows of one group that agree in the first
    order column stay together.
    """
    first = F.coalesce(ordinal(df, order[0]), F.lit(float("-inf")))
    placed = df.withColumn("__v", first)
    hot = placed.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > GROUP_ROWS)
    of_hot = placed.join(hot, same_keys(placed, hot, keys, "__g_")).groupBy(*[f"__g_{k}" for k in keys])
    cuts = of_hot.agg(F.percentile_approx("__v", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(2000)).alias("__cuts"))
    cut = placed.join(cuts, same_keys(placed, cuts, keys, "__g_"), "left").drop(*[f"__g_{k}" for k in keys])
    cut = cut.withColumn("__piece", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__v"))), F.lit(0))).drop("__cuts", "__v")
    sizes = cut.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys], F.col("__piece").alias("__p")).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*[f"__g_{k}" for k in keys]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("__start", before).filter("__start IS NOT NULL").drop("__size")
    ranked = cut.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__piece").orderBy(*order)))
    told = ranked.join(starts, same_keys(ranked, starts, keys, "__g_") & (F.col("__piece") == F.col("__p")), "left")
    return told.withColumn(out, F.col("__r") + F.coalesce("__start", F.lit(0))).drop(*[f"__g_{k}" for k in keys], "__p", "__start", "__r", "__piece")


def disambiguate_key(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """`out`: the key as text, with -1, -2, ... by `order` where it repeats; a null key stays null."""
    told = with_group(df, [key], [F.count(F.lit(1)).alias("__n")], "__n > 1")
    alone = told.filter("__n IS NULL").drop("__n").withColumn(out, F.col(key).cast("string"))
    again = rank_in_groups(told.filter("__n > 1").drop("__n"), [key], order, "__place")
    return alone.unionByName(again.withColumn(out, F.concat(F.col(key).cast("string"), F.lit("-"), F.col("__place").cast("string"))).drop("__place"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def split_orphans(df: DataFrame, parent: DataFrame, on: list[str], reason: str = "orphan") -> tuple[DataFrame, DataFrame]:
    """Rows with and without a row of `parent`."""
    keys = parent.select(*on).distinct()
    return df.join(keys, on, "left_semi"), rejected(df.join(keys, on, "left_anti"), reason)


def split_sentinel(df: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """Rows whose column does not hold the sentinel (or is null), and those that do."""
    is_it = F.coalesce(F.col(column) == value, F.lit(False))
    return df.filter(~is_it), rejected(df.filter(is_it), f"sentinel {column}", F.col(column))


def split_cascade(child: DataFrame, kept: DataFrame, gone: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Children whose parent was rejected as a whole go too."""
    lost = gone.select(*on).distinct().join(kept.select(*on).distinct(), on, "left_anti")
    return child.join(lost, on, "left_anti"), rejected(child.join(lost, on, "left_semi"), "parent rejected")


def only_values(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, column, ...): of each group the value of a column, null where it has several or none."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    return df.groupBy(group).agg(*[one(c) for c in columns])


def repair_from_siblings(df: DataFrame, group: str, column: str, parent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An unknown value takes the only known one of its group, else the row goes. parent: the known values. Only rows with
    an unknown value are joined with their group's; a null group has no siblings."""
    known = parent.select(F.col(column)).distinct().withColumn("__known", F.lit(True))
    seen = df.join(known, column, "left")
    valid = seen.filter("__known").drop("__known")
    only = only_values(valid, group, [column]).select(F.col(group).alias("__group"), F.col(column).alias("__one"))
    unknown = seen.filter("__known IS NULL").drop("__known")
    found = unknown.join(only, F.col(group) == F.col("__group"), "left").drop("__group")
    fixed = found.filter("__one IS NOT NULL").withColumns({column: F.col("__one"), "repaired": F.lit(True)}).drop("__one")
    kept = valid.withColumn("repaired", F.lit(False)).unionByName(fixed)
    return kept, rejected(found.filter("__one IS NULL").drop("__one"), f"unknown {column}", F.col(column))


def row_accounting(raw: DataFrame, kept: DataFrame, gone: DataFrame, by: str) -> DataFrame:
    """Per value of `by`: rows in, kept, rejected, and their difference, which must be 0."""
    count = lambda df, n: df.groupBy(by).agg(F.count(F.lit(1)).alias(n))
    out = count(raw, "rows_in").join(count(kept, "rows_kept"), by, "full").join(count(gone, "rows_rejected"), by, "full").na.fill(0, ["rows_in", "rows_kept", "rows_rejected"])
    return out.withColumn("difference", F.col("rows_in") - F.col("rows_kept") - F.col("rows_rejected"))


def infer_status(df: DataFrame, child: DataFrame, on: list[str], status: str, value: str) -> DataFrame:
    """A null status becomes `value` where the row has no child."""
    has = child.select(*on).distinct().withColumn("__has", F.lit(True))
    return df.join(has, on, "left").withColumn(status, F.when(F.col(status).isNull() & F.col("__has").isNull(), value).otherwise(F.col(status))).drop("__has")


def fill_from(df: DataFrame, ref: DataFrame, on: str, column: str) -> DataFrame:
    """A null takes the related table's value where that has exactly one; `column`_filled marks it."""
    one = ref.groupBy(on).agg(F.countDistinct(column).alias("__n"), F.min(column).alias("__value")).filter("__n = 1").drop("__n")
    out = df.join(one, on, "left").withColumn(f"{column}_filled", F.col(column).isNull() & F.col("__value").isNotNull())
    return out.withColumn(column, F.coalesce(column, "__value")).drop("__value")


def fill_if_rule_proven(df: DataFrame, column: str, rule: Column) -> DataFrame:
    """Nulls take the rule's value if the rule gives every value that is known; `rule_violations` counts those it does not."""
    wrong = df.agg(F.count_if(F.col(column).isNotNull() & ~F.col(column).eqNullSafe(rule)).alias("rule_violations"))
    return df.crossJoin(F.broadcast(wrong)).withColumn(column, F.when(F.col("rule_violations") == 0, F.coalesce(F.col(column), rule)).otherwise(F.col(column)))


def fill_constant_in_group(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Nulls take the value of their group where it has one only. Rows without a null are not joined; a null key has no
    group."""
    blank = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    only = only_values(df, key, columns).select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    filled = df.filter(blank).join(only, F.col(key) == F.col("__key"), "left").withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns})
    return df.filter(~blank).unionByName(filled.select(*df.columns))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often two columns agree, differ, or one is missing."""
    return df.agg(F.count_if(F.col(a) == F.col(b)).alias("same"), F.count_if(F.col(a) != F.col(b)).alias("different"), F.count_if(F.col(a).isNull() | F.col(b).isNull()).alias("missing"))


def conform_to_parent(df: DataFrame, ref: DataFrame, on: str, column: str) -> DataFrame:
    """The column takes the parent's value; `column`_mismatch marks rows that said otherwise."""
    named = ref.select(on, F.col(column).alias("__parent"))
    out = df.join(named, on, "left").withColumn(f"{column}_mismatch", F.coalesce(F.lower(column) != F.lower("__parent"), F.lit(False)))
    return out.withColumn(column, F.coalesce("__parent", column)).drop("__parent")


def flag_exceeds_parent(child: DataFrame, parent: DataFrame, on: str, amount: str, value: str, slack: float = 0.005) -> DataFrame:
    """`exceeds_parent`: the absolute amount is above the sum of the parent's value."""
    sums = parent.groupBy(on).agg(F.sum(value).alias("__value"))
    return child.join(sums, on, "left").withColumn("exceeds_parent", F.coalesce(F.abs(amount) > F.col("__value") + F.lit(slack).cast("decimal(6,3)"), F.lit(False))).drop("__value")


def flag_outside_window(child: DataFrame, parent: DataFrame, on: str, day: str, parent_day: str, least: int, most: int) -> DataFrame:
    """`outside_window`: the day is not `least` to `most` days after the parent's first one; null if either day is missing."""
    first = parent.groupBy(on).agg(F.min(parent_day).alias("__first"))
    return child.join(first, on, "left").withColumn("outside_window", ~F.datediff(day, "__first").between(least, most)).drop("__first")


def repeat_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key another row has too, and all rows."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"), F.sum("n").alias("all_rows"))


def orphan_evidence(gone: DataFrame, parent: DataFrame, key: str, day: str, guests: DataFrame | None = None) -> DataFrame:
    """Of rejected rows: rows, distinct ids, their range beside the real one's, months touched, and how many of their ids are
    among those of guests (rows of the same key), if these are given."""
    real = parent.agg(F.min(key).alias("real_min"), F.max(key).alias("real_max"))
    found = gone.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("ids"), F.min(key).alias("orphan_min"), F.max(key).alias("orphan_max"), F.countDistinct(F.date_format(day, "yyyy-MM")).alias("months"))
    told = found.crossJoin(F.broadcast(real))
    if guests is None:
        return told
    met = gone.select(key).distinct().join(guests.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("guest_ids"))
    return told.crossJoin(F.broadcast(met))


def name_suffix(name: Column, known: list[str]) -> Column:
    """The value from a list that the name ends with, after a space, whatever the case; the longest of several."""
    lower = F.lower(F.trim(name))
    return F.coalesce(*[F.when(lower.endswith(" " + k.lower()), k) for k in sorted(known, key=len, reverse=True)])


def negative_line_evidence(df: DataFrame, order: str, sku: str, quantity: str, value: str) -> DataFrame:
    """Of lines with negative quantity: how many stand beside a sale of the same SKU, alone on their order, their value."""
    sold = df.filter(F.col(quantity) > 0).select(order, sku).distinct().withColumn("__sale", F.lit(True))
    sizes = df.groupBy(order).agg(F.count(F.lit(1)).alias("__lines"))
    negative = df.filter(F.col(quantity) < 0).join(sold, [order, sku], "left").join(sizes, order)
    return negative.agg(F.count(F.lit(1)).alias("negative"), F.count("__sale").alias("beside_sale"), F.count_if(F.col("__lines") == 1).alias("alone"), F.sum(value).alias("value"))


def value_rejected(gone: DataFrame, field: str, revenue_reasons: list[str]) -> DataFrame:
    """By table and reason of quarantined rows, with sub-totals: rows, value in the payload's field, revenue affected."""
    amount = F.get_json_object("payload", f"$.{field}").try_cast("decimal(18,2)")
    rows = gone.withColumn("value", amount).withColumn("affected", F.col("reason").isin(revenue_reasons))
    return rows.rollup("src_table", "reason").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("affected"), F.col("value"))).alias("at_risk"), F.bool_or("affected").alias("affects_revenue"))


def flag(df: DataFrame, flags: list[tuple[Column, str]], out: str = "dq_flags") -> DataFrame:
    """`out`: the names of the conditions that hold, comma-separated; null if none."""
    found = F.array_compact(F.array(*[F.when(c, n) for c, n in flags]))
    return df.withColumn(out, F.when(F.size(found) > 0, F.array_join(found, ",")))


def flag_counts(df: DataFrame, column: str = "dq_flags") -> DataFrame:
    """How often each flag is set."""
    return df.select(F.explode(F.split(column, ",")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def unify_sources(sources: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """One table from sources that name their columns differently; missing columns are null, `src_file` names the source.
    Columns of one name must have one type; repeated rows stay; an empty source gives no row."""
    parts = [df.withColumnsRenamed(renames).withColumn("src_file", F.lit(name)) for name, (df, renames) in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
