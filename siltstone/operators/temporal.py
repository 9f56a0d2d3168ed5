"""Time-valid data: rates without gaps and slips, repaired price versions, validity joins, learned windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"
#: Accuracy of the approximate percentiles that bracket an exact one.
ACCURACY = 50_000


def correct_rate_outliers(fx: DataFrame, factor: float = 5, near: float = 0.15) -> DataFrame:
    """A rate more than `factor` times (or less than one `factor`th of) all its published neighbours that is within
    `near` of one after a shift of the decimal point is shifted. fx: (currency, rate_date, rate)."""
    w = Window.partitionBy("currency").orderBy("rate_date")
    r, before, after = F.col("rate").cast("double"), F.lag("rate").over(w).cast("double"), F.lead("rate").over(w).cast("double")
    every = lambda f: F.coalesce(f(before), F.lit(True)) & F.coalesce(f(after), F.lit(True)) & (before.isNotNull() | after.isNotNull())
    close = lambda x: F.coalesce(F.abs(x / before - 1) <= near, F.lit(False)) | F.coalesce(F.abs(x / after - 1) <= near, F.lit(False))
    high, low = every(lambda n: r > factor * n) & close(r / 10), every(lambda n: r < n / factor) & close(r * 10)
    fixed = F.when(high, F.col("rate") / 10).when(low, F.col("rate") * 10).otherwise(F.col("rate")).cast("decimal(14,6)")
    return fx.withColumn("__fixed", fixed).withColumn("is_corrected", high | low).withColumn("rate", F.col("__fixed")).drop("__fixed")


def _days(fx: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """(currency, rate_date) for every day from start to end, by default from a currency's first rate to its last."""
    span = fx.groupBy("currency").agg(F.min("rate_date").alias("a"), F.max("rate_date").alias("b"))
    bound = lambda given, own: F.col(own) if given is None else F.lit(given).cast("date")
    return span.select("currency", F.explode(F.sequence(bound(start, "a"), bound(end, "b"))).alias("rate_date"))


def daily_calendar(fx: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A rate for every day and currency: the last one published, before the first one the first; filled days are not
    corrected. One row of fx per currency and day; a null rate counts as not published."""
    days = _days(fx, start, end)
    w = Window.partitionBy("currency").orderBy("rate_date")
    up, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    all_days = days.join(fx.withColumn("__d", F.col("rate_date")), ["currency", "rate_date"], "left")
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(up), F.first(c, ignorenulls=True).over(on))
    return all_days.select("currency", "rate_date", fill("rate").alias("rate"), F.col("rate").isNull().alias("is_filled"), fill("__d").alias("source_rate_date"), F.coalesce("is_corrected", F.lit(False)).alias("is_corrected"))


def rate_steps(fx: DataFrame, listed: float = 1.2, rejected: float = 2.0) -> DataFrame:
    """Day-over-day steps beyond `listed` either way, and whether they are beyond `rejected`."""
    step = F.col("rate").cast("double") / F.lag("rate").over(Window.partitionBy("currency").orderBy("rate_date")).cast("double")
    out = fx.withColumn("step", step).filter((F.col("step") > listed) | (F.col("step") < 1 / listed))
    return out.select("currency", "rate_date", F.round("step", 6).alias("step"), ((F.col("step") > rejected) | (F.col("step") < 1 / rejected)).alias("is_rejected"))


def missing_weekdays(fx: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Days from Monday to Friday without a published rate."""
    days = _days(fx, start, end).filter(F.weekday("rate_date") < 5)
    return days.join(fx.select("currency", "rate_date"), ["currency", "rate_date"], "left_anti")


def repair_scd2(df: DataFrame, key: str, lo: str = "valid_from", hi: str = "valid_to") -> DataFrame:
    """Versions without overlap and gap: inverted windows are swapped, each ends the day before the next begins, the last
    stays open and is current; `repair` names what was done."""
    swapped = F.col(hi).isNotNull() & (F.col(hi) < F.col(lo))
    a, b = F.when(swapped, F.col(hi)).otherwise(F.col(lo)), F.when(swapped, F.col(lo)).otherwise(F.col(hi))
    ordered = df.withColumns({"__a": a, "__b": b, "__s": swapped})
    following = F.lead("__a").over(Window.partitionBy(key).orderBy("__a", F.col("__b").asc_nulls_last()))
    out = ordered.withColumn("__next", following)
    change = F.when(F.col("__next").isNull(), F.when(F.col("__b").isNotNull(), "reopened")).when(F.col("__b").isNull(), "closed").when(F.col("__b") >= F.col("__next"), "trimmed").when(F.col("__b") < F.date_sub("__next", 1), "bridged")
    repair = F.array_join(F.array_compact(F.array(F.when(F.col("__s"), "swapped"), change)), ",")
    return out.withColumns({lo: F.col("__a"), hi: F.coalesce(F.date_sub("__next", 1), F.lit(FOREVER).cast("date")), "is_current": F.col("__next").isNull(), "repair": repair}).drop("__a", "__b", "__s", "__next")


def check_scd2(df: DataFrame, key: str, lo: str = "valid_from", hi: str = "valid_to", current: str = "is_current") -> DataFrame:
    """Counts of overlaps, gaps, repeated starts, and keys without exactly one current version; all must be 0."""
    w = Window.partitionBy(key).orderBy(lo, hi)
    steps = df.withColumn("__end", F.lag(hi).over(w)).withColumn("__start", F.lag(lo).over(w))
    a = steps.agg(F.count_if(F.col("__end") >= F.col(lo)).alias("overlaps"), F.count_if(F.date_add("__end", 1) < F.col(lo)).alias("gaps"), F.count_if(F.col("__start") == F.col(lo)).alias("repeated_starts"))
    b = df.groupBy(key).agg(F.count_if(current).alias("c")).agg(F.count_if(F.col("c") != 1).alias("keys_without_one_current"))
    return a.crossJoin(F.broadcast(b))


def join_valid(df: DataFrame, scd: DataFrame, key: str, day: str, lo: str = "valid_from", hi: str = "valid_to") -> DataFrame:
    """Each event with the version in force on its day, for keys with a few versions: an equi-join on the key with the window
    as residual condition. Versions are dealt by key, never broadcast: their size is guessed from that of the files below them,
    which may be a small part of it. `intervals.join_intervals` and `join_as_of` are for keys with many."""
    versions = scd.withColumnsRenamed({key: "__key"}).hint("shuffle_hash")
    return df.join(versions, (F.col(key) == F.col("__key")) & F.col(day).between(F.col(lo), F.col(hi)), "left").drop("__key")


def price_evidence(lines: DataFrame, paid: str, listed: str, by: str) -> DataFrame:
    """Paid over list price by a flag: number, median, 5th and 95th percentile, share within a quarter."""
    r = F.col(paid).cast("double") / F.col(listed).cast("double")
    rows = lines.filter((F.col(listed) > 0) & r.isNotNull()).select(by, r.alias("__r"))
    parts = exact_percentiles(rows, [by], "__r", {"median": 0.5, "p05": 0.05, "p95": 0.95})
    shares = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("__r").between(0.75, 1.25).cast("int")), 6).alias("within_quarter"))
    return shares.join(parts, F.col(by).eqNullSafe(F.col("__by"))).select(by, "n", *[F.round(p, 6).alias(p) for p in ("median", "p05", "p95")], "within_quarter")


def exact_percentiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Per group (first column of `by` as __by) the wanted percentiles, interpolated, exact.

    A first pass brackets each percentile between two approximate ones, whose ranks are off by at most a part in ACCURACY. A
    second one counts what is below a bracket (with its greatest value), above it (with its least) and, by value, inside it;
    only the insides, a few parts in ACCURACY of the group, are put in order. Rows stay where they are: the brackets, a few
    numbers a group, go to them. So groups are labels, whose sketches and brackets a task can hold. Nulls are left out;
    groups of nulls only are missing from the result.
    """
    known = rows.filter(F.col(value).isNotNull()).select(F.col(by[0]).alias("__by"), F.col(value).alias("__v"))
    near = [min(1.0, max(0.0, p + side * 2 / ACCURACY)) for p in wanted.values() for side in (-1, 1)]
    brackets = known.groupBy(F.col("__by").alias("__g")).agg(F.count(F.lit(1)).alias("__all"), F.percentile_approx("__v", F.array(*[F.lit(x) for x in near]), F.lit(ACCURACY)).alias("__at"))
    beside = known.join(F.broadcast(brackets), F.col("__by").eqNullSafe(F.col("__g")))
    side = lambda i: F.when(F.col("__v") < F.get("__at", F.lit(2 * i)), -1).when(F.col("__v") > F.get("__at", F.lit(2 * i + 1)), 1).otherwise(0)
    # rows are counted by their sides of all brackets at once, and told apart by percentile when they are few
    sides = [f"__side{i}" for i in range(len(wanted))]
    told = beside.select("__g", "__all", "__v", *[side(i).alias(s) for i, s in enumerate(sides)])
    within = reduce(lambda a, b: a | b, [F.col(s) == 0 for s in sides])
    few = told.groupBy("__g", "__all", *sides, F.when(within, F.col("__v")).alias("__inner")).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    laid = few.select("__g", "__all", "__inner", "__n", "__least", "__most", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(s).alias("side")) for i, s in enumerate(sides)])).alias("x"))
    key = F.when(F.col("x.side") == 0, F.col("__inner"))
    counts = laid.groupBy("__g", "__all", F.col("x.i").alias("__i"), F.col("x.side").alias("__side"), key.alias("__key")).agg(F.sum("__n").alias("__n"), F.min("__least").alias("__least"), F.max("__most").alias("__most"))
    up = Window.partitionBy("__g", "__i").orderBy("__side", "__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("__to", F.sum("__n").over(up)).withColumn("__from", F.col("__to") - F.col("__n"))
    found = placed.groupBy(F.col("__g").alias("__by")).agg(*[_at_rank(name, i, p) for i, (name, p) in enumerate(wanted.items())])
    low, high = (lambda n: F.col(f"{n}.low").cast("double")), (lambda n: F.col(f"{n}.high").cast("double"))
    return found.select("__by", *[(low(n) + (high(n) - low(n)) * F.col(f"{n}.part")).alias(n) for n in wanted])


def _at_rank(name: str, i: int, p: float) -> Column:
    """The values at the ranks beside p * (n - 1), from 0, and the part between. What is below a bracket may hold a rank as
    its last, what is above as its first."""
    place = F.lit(p) * (F.col("__all") - 1)
    inside = lambda rank: (F.col("__i") == i) & (F.col("__from") <= rank) & (rank < F.col("__to"))
    value = lambda rank: F.max(F.when(inside(rank), F.when(F.col("__side") < 0, F.col("__most")).otherwise(F.col("__least"))))
    return F.struct(value(F.floor(place)).alias("low"), value(F.ceil(place)).alias("high"), F.max(place - F.floor(place)).alias("part")).alias(name)


def two_readings(c: Column) -> tuple[Column, Column]:
    """An a/b/yyyy date read day first and month first; null where a reading is impossible."""
    read = lambda fmt: F.to_date(F.try_to_timestamp(c, F.lit(fmt)))
    return read("d/M/yyyy"), read("M/d/yyyy")


def resolve_ambiguous_dates(df: DataFrame, raw: str, bases: list[str]) -> tuple[DataFrame, DataFrame]:
    """`resolved`: the reading whose lag to the chosen day basis fits the window that unambiguous rows span; null where both
    or none do. And the windows: (basis, lag_min, lag_max, sure, is_chosen).

    bases: columns of days that the lag may count from, of which the one with the tightest window is chosen, the first of
    equal ones; all windows are learned in one pass. A basis without an unambiguous row is never chosen before one with."""
    d, m = two_readings(F.col(raw))
    rows = df.withColumns({"__d": d, "__m": m})
    sure = F.when(F.col("__d").isNull() | (F.col("__d") == F.col("__m")), F.col("__m")).when(F.col("__m").isNull(), F.col("__d"))
    lag = lambda c: F.datediff(sure, F.col(c))
    learned = rows.agg(*[f(lag(c)).alias(f"__{n}{i}") for i, c in enumerate(bases) for n, f in (("a", F.min), ("b", F.max))], F.count(sure).alias("sure"))
    each = [F.struct(F.lit(c).alias("basis"), F.lit(i).alias("i"), F.col(f"__a{i}").alias("lag_min"), F.col(f"__b{i}").alias("lag_max")) for i, c in enumerate(bases)]
    width = [F.struct((F.col(f"__b{i}") - F.col(f"__a{i}")).isNull(), F.col(f"__b{i}") - F.col(f"__a{i}"), F.lit(i), e) for i, e in enumerate(each)]
    window = learned.select("sure", F.array(*each).alias("windows"), F.array_min(F.array(*width))["col4"].alias("best"))
    out = rows.withColumn("__sure", sure).crossJoin(F.broadcast(window))
    base = F.get(F.array(*[F.col(c) for c in bases]), F.col("best.i"))
    fits = lambda c: F.coalesce(F.datediff(F.col(c), base).between(F.col("best.lag_min"), F.col("best.lag_max")), F.lit(False))
    resolved = F.when(F.col("__sure").isNotNull(), F.col("__sure")).when(fits("__d") & ~fits("__m"), F.col("__d")).when(fits("__m") & ~fits("__d"), F.col("__m"))
    told = window.select("sure", "best", F.explode("windows").alias("w")).select("w.basis", "w.lag_min", "w.lag_max", "sure", (F.col("w.i") == F.col("best.i")).alias("is_chosen"))
    return out.withColumn("resolved", resolved).select(*df.columns, "resolved"), told


def calendar(days: DataFrame) -> DataFrame:
    """Of each day: year, quarter, ISO year and week, week start, weekend, peak season (November, December)."""
    return days.select("day", F.year("day").alias("year"), F.quarter("day").alias("quarter"), F.concat(F.year("day").cast("string"), F.lit("Q"), F.quarter("day").cast("string")).alias("year_quarter"),
        F.extract(F.lit("YEAROFWEEK"), "day").cast("int").alias("iso_year"), F.weekofyear("day").alias("iso_week"), F.trunc("day", "WEEK").alias("week_start"), (F.weekday("day") >= 5).alias("is_weekend"), F.month("day").isin(11, 12).alias("is_peak"))


def attribution_lag(sessions: DataFrame, orders: DataFrame, on: str, session_day: str, order_day: str) -> DataFrame:
    """Sessions with an order: number, median absolute days between, share of sessions before their order."""
    d = F.datediff(F.col(session_day), F.col(order_day))
    return sessions.join(orders, on).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.abs(d), F.lit(0.5)).alias("median_days"), F.round(F.avg((d < 0).cast("int")), 6).alias("before"))


def allocate_refunds(lines: DataFrame, refunds: DataFrame, order: str, value: str, amount: str, day: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Refunds of an order consumed in (day, key) order up to its positive value (`counted`), and each positive line's
    share of them pro rata (`refunded`). Refunds of an order without lines count nothing; null days come last; lines that
    are null or not positive get nothing; orders without refunds have 0."""
    worth = lines.groupBy(order).agg(F.sum(F.when(F.col(value) > 0, F.col(value)).otherwise(0)).alias("__worth"), F.sum(value).alias("__net"))
    w = Window.partitionBy(order).orderBy(F.col(day).asc_nulls_last(), key).rowsBetween(Window.unboundedPreceding, -1)
    cap = F.greatest(F.lit(0), F.col("__net"))
    before = F.coalesce(F.sum(F.abs(amount)).over(w), F.lit(0))
    counted = refunds.join(worth, order, "left").withColumn("counted", F.coalesce(F.greatest(F.lit(0), F.least(F.abs(amount), cap - before)), F.lit(0)).cast("decimal(18,2)")).drop("__worth", "__net")
    totals = counted.groupBy(order).agg(F.sum("counted").alias("__counted"))
    share = F.when((F.col(value) > 0) & (F.col("__worth") > 0), F.round(F.col(value).cast("double") / F.col("__worth").cast("double") * F.coalesce("__counted", F.lit(0)).cast("double"), 6)).otherwise(0.0)
    shared = lines.join(worth, order).join(totals, order, "left").withColumn("refunded", F.round(share, 2)).drop("__worth", "__net", "__counted")
    return counted, shared
