"""Column profiles: nulls, distinct values, shapes and inferred types, exact by digests or in one pass by sketches."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.scratch import new_path

#: Type classes and their patterns (fixed values); the first that fits most values wins.
CLASSES = {
    "boolean": r"(?i)^(true|false|yes|no|t|f|y|n|1|0)$",
    "integer": r"^-?\d{1,18}$",
    "decimal": r"^-?\d*\.\d+$",
    "timestamp": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}",
    "date": r"^(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-[A-Za-z]{3}-\d{2,4}|[A-Za-z]+ \d{1,2}, \d{4}|\d{1,2}\.\d{1,2}\.\d{4})$",
    "money": r"(?i)^[(-]?([$₦£€]|ngn|usd|gbp|eur) ?\d[\d,]*(\.\d+)?\)?$|^[(-]?\d{1,3}(,\d{3})+(\.\d+)?\)?$",
}
#: Least values of a column that are given as examples, and the characters of a value that are shown.
EXAMPLES, SHOWN = 3, 40
#: Pieces of a column of which each has a least value.
PIECES = 64


def cell(df: DataFrame, column: str) -> Column:
    """A cell as text; arrays, maps and structs as JSON."""
    c = F.col(f"`{column}`")
    return F.to_json(c) if dict(df.dtypes)[column].startswith(("array", "map", "struct")) else c.cast("string")


def _kept(text: Column) -> Column:
    """A text of up to SHOWN characters as it is, a longer one as its first SHOWN characters and a digest of 128 bits; these are
    longer than any of the former, so no two texts are taken for one."""
    return F.when(F.length(text) <= SHOWN, text).otherwise(F.concat(F.substring(text, 1, SHOWN), F.md5(text.cast("binary"))))


def shape(c: Column) -> Column:
    """Runs of digits as 9, runs of letters as A. Letters first, as that leaves less to look at."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}+", "A"), r"\d+", "9")


def _bits(c: Column, s: Column) -> Column:
    """The classes that a text of shape s fits, a bit for each in their order. A pattern is tried only where the shape, which
    may end in a line break of two characters, allows it."""
    n, starts = F.length(s), lambda *xs: reduce(lambda a, b: a | b, [s.startswith(x) for x in xs])
    may = {
        "boolean": (n <= 3) & (F.length(c) <= 7), "integer": (n <= 4) & starts("9", "-9"), "decimal": (n <= 6) & starts("9.9", ".9", "-9.9", "-.9"),
        "timestamp": starts("9-9-9 9:9", "9-9-9A9:9"), "date": n.between(5, 8) & starts("9-9-9", "9/9/9", "9-A-9", "A 9, 9", "9.9.9"),
        "money": (~s.startswith("9") | s.startswith("9,9")) & s.contains("9") & F.substring(s, 1, 4).rlike(r"^[(-]?([$₦£€A] ?9|9,9)"),
    }
    return reduce(lambda a, b: a + b, [F.when(may[k] & c.rlike(p), 1 << i).otherwise(0) for i, (k, p) in enumerate(CLASSES.items())])


def _has(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(F.lit(1 << list(CLASSES).index(name))) > 0


def _known(c: Column, null_spellings: tuple[str, ...]) -> Column:
    """The cell, null where it is blank or spells a null."""
    bare = F.trim(c)
    # a long text is not looked at letter by letter
    return F.when((F.length(bare) > max(map(len, null_spellings))) | ~F.lower(bare).isin("", *null_spellings), c)


def _classified(known: Column, counts: dict[str, Column]) -> Column:
    """The type of a column from its number of known cells and of those that fit each class."""
    number = counts["integer"] + counts["decimal"]
    best = F.array_max(F.array(*[F.struct((number if k == "decimal" else counts[k]).alias("r"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(CLASSES)]))
    return F.when((known == 0) | (best["r"] * 2 < known), "text").when((best["k"] == "decimal") & (counts["decimal"] == 0), "integer").otherwise(best["k"])


def _cells(df: DataFrame, first: int, null_spellings: tuple[str, ...]) -> DataFrame:
    """(c, d, s, m) for every cell: the number of its column, from `first` on, and its text as kept. Of longer texts also their
    shape as kept and the classes that they fit, which a kept text does not tell; texts of null are null."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(first + i).alias("c"), cell(df, c).alias("t")) for i, c in enumerate(df.columns)])))
    t, k, s = F.col("t"), F.col("k"), F.col("s")
    long = F.length(t) > SHOWN
    # one step after another, so no text is looked at twice
    rows = rows.withColumn("k", F.when(long, _known(t, null_spellings))).withColumn("s", shape(k))
    return rows.select("c", F.when(long, _kept(k)).otherwise(t).alias("d"), _kept(s).alias("s"), F.when(long, _bits(k, s)).alias("m"))


def _stored(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "profile")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def profile(tables: dict[str, DataFrame], null_spellings: tuple[str, ...]) -> DataFrame:
    """Per column: rows, nulls, null rate, distinct values and shapes, inferred type, least and greatest value, examples.

    Tables are read once. Equal cells are counted before anything else is done with them, and these counts are stored in the
    shared folder; of a cell of more than SHOWN characters its first ones and digests are moved, never the value, and no task
    holds a column. Blank cells and spellings of null are nulls; a column of nulls only is text.
    """
    names, cells = [(name, c) for name, df in tables.items() for c in df.columns], []
    for name, df in tables.items():
        cells.append(_cells(df, names.index((name, df.columns[0])), null_spellings))
    counted = reduce(lambda a, b: a.unionByName(b), cells).groupBy("c", "d", "s", "m").agg(F.count(F.lit(1)).alias("n"))
    long = F.length("d") > SHOWN
    known = counted.withColumn("d", F.when(long, F.col("d")).otherwise(_known(F.col("d"), null_spellings)))
    shaped = known.withColumn("s", F.when(long, F.col("s")).otherwise(shape(F.col("d"))))
    values = _stored(shaped.select("c", "d", "n", F.when(long, F.col("s")).otherwise(_kept(F.col("s"))).alias("s"), F.when(long, F.col("m")).otherwise(_bits(F.col("d"), F.col("s"))).alias("m")))
    values = values.withColumn("p", F.substring("d", 1, SHOWN))
    some = F.col("d").isNotNull()
    # each column in pieces by the hash of the value: the third least of their least values is no less than the third least value
    rows = [F.coalesce(F.sum(F.when(_has(F.col("m"), k), F.col("n"))), F.lit(0)).alias(f"r_{k}") for k in CLASSES]
    pieces = values.groupBy((F.col("c") * PIECES + F.pmod(F.hash("d"), F.lit(PIECES))).alias("piece")).agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("nulls"), F.count("d").alias("distinct_values"), F.min("p").alias("least"), F.max("p").alias("greatest"), *rows,
    )
    sums = [F.sum(x).alias(x) for x in ("n_rows", "nulls", "distinct_values", *[f"r_{k}" for k in CLASSES])]
    stats = _stored(pieces.groupBy(F.floor(F.col("piece") / PIECES).cast("int").alias("c")).agg(*sums, F.get(F.array_sort(F.collect_list("least")), F.lit(EXAMPLES - 1)).alias("bound"), F.min("least").alias("least"), F.max("greatest").alias("greatest")))
    shapes = values.filter(some).groupBy("c", "s").agg(F.lit(1).alias("one")).groupBy("c").agg(F.count(F.lit(1)).alias("distinct_shapes"))
    near = values.filter(some).select("c", "p", "d").join(F.broadcast(stats.select("c", "bound")), "c").filter(F.col("bound").isNull() | (F.col("p") <= F.col("bound")))
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("p", "d"))).filter(F.col("r") <= EXAMPLES)
    examples = few.groupBy("c").agg(F.array_join(F.array_sort(F.collect_list("p")), " | ").alias("examples"))
    kind = _classified(F.col("n_rows") - F.col("nulls"), {k: F.col(f"r_{k}") for k in CLASSES})
    named = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in names]), F.col("c") + 1)
    joined = stats.join(shapes, "c", "left").join(examples, "c", "left")
    return joined.select(named(0).alias("table"), named(1).alias("column"), "n_rows", "nulls", F.round(F.col("nulls") / F.col("n_rows"), 6).alias("null_rate"), "distinct_values", F.coalesce("distinct_shapes", F.lit(0)).alias("distinct_shapes"), "least", "greatest", kind.alias("type"), F.coalesce("examples", F.lit("")).alias("examples"))


class _Cells(NamedTuple):
    """Rows (c, l, x, t, s, z, m, n), n equal cells: the number of a column and a whole number, double or time as it is, where
    its text can have one form only, else its text, shape and classes, texts as kept; all null where the cells are null or spell
    a null. Also the table and name of each column."""

    rows: DataFrame
    names: list[tuple[str, str]]

    def named(self, i: int) -> Column:
        return F.element_at(F.array(*[F.lit(x[i]) for x in self.names]), F.col("c") + 1)


def _typed_cells(tables: dict[str, DataFrame], null_spellings: tuple[str, ...], shaped: Callable[[Column], Column]) -> _Cells:
    """Every cell of every table, with shape and classes of those texts for which `shaped` holds. Cells stand below each other,
    so what is compiled to look at them is as short for wide tables as for narrow ones, short enough to be optimised."""
    names, parts = [(name, c) for name, df in tables.items() for c in df.columns], []
    # a spelling of null that holds a digit may be a number
    typed, fields = not any(re.search(r"\d", x) for x in null_spellings), {"l": "bigint", "x": "double", "t": "timestamp_ntz", "s": "string"}
    for name, df in tables.items():
        cells = []
        for c, kind in df.dtypes:
            of = "s" if not typed else "l" if kind in ("tinyint", "smallint", "int", "bigint") else "x" if kind == "double" else "t" if kind.startswith("timestamp") else "s"
            told = cell(df, c) if of == "s" else F.col(f"`{c}`").cast(fields[of])
            cells.append(F.struct(F.lit(names.index((name, c))).alias("c"), *[(told if k == of else F.lit(None).cast(v)).alias(k) for k, v in fields.items()]))
        parts.append(df.select(F.inline(F.array(*cells))))
    s, t, x, z = F.col("s"), F.col("t"), F.col("x"), F.col("z")
    # outside of these the text of a double has an exponent or is no number, and years have a sign
    usual_x, usual_t = F.abs(x).between(0.001, 9_999_999.0), t.between(F.expr("timestamp_ntz'0001-01-01 00:00:00'"), F.expr("timestamp_ntz'9999-12-31 23:59:59.999999'"))
    text = F.when(~usual_x, x.cast("string")).when(~usual_t, t.cast("string")).otherwise(s)
    rows = reduce(lambda a, b: a.unionByName(b), parts).select("c", "l", F.when(usual_x, x).alias("x"), F.when(usual_t, t).alias("t"), text.alias("s"))
    # one step after another, so no text is looked at twice
    rows = rows.withColumn("s", _known(s, null_spellings)).withColumn("z", F.when(shaped(s), shape(s)))
    return _Cells(rows.select("c", "l", "x", "t", _kept(s).alias("s"), _kept(z).alias("z"), F.when(z.isNotNull(), _bits(s, z)).alias("m"), F.lit(1).cast("bigint").alias("n")), names)


def _counted(tables: dict[str, DataFrame], null_spellings: tuple[str, ...]) -> _Cells:
    """Equal cells once, in the shared folder. They meet by numbers, times and kept texts, before the shape of a short text is
    looked for."""
    cells = _typed_cells(tables, null_spellings, lambda s: F.length(s) > SHOWN)
    s, z = F.col("s"), F.col("z")
    rows = cells.rows.groupBy("c", "l", "x", "t", "s", "z", "m").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("w", F.when(z.isNull(), shape(s)))
    return cells._replace(rows=_stored(rows.select("c", "l", "x", "t", "s", F.coalesce(z, _kept(F.col("w"))).alias("z"), F.coalesce("m", _bits(s, F.col("w"))).alias("m"), "n")))


def _by_kind(l: Callable, x: Callable, t: Callable, s: Callable) -> Column:
    """What is told of a typed cell by what it holds; null where it holds nothing."""
    return reduce(lambda a, k: a.when(F.col(k[0]).isNotNull(), k[1](F.col(k[0]))), (("x", x), ("t", t), ("s", s)), F.when(F.col("l").isNotNull(), l(F.col("l"))))


def _typed_shape(told: Callable[[Column], Column]) -> Column:
    """`told` of the shape of a cell."""
    parted = lambda t: F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)) != 0
    either = lambda b, yes, no: F.when(b, told(F.lit(yes))).otherwise(told(F.lit(no)))
    return _by_kind(lambda l: either(l < 0, "-9", "9"), lambda x: either(x < 0, "-9.9", "9.9"), lambda t: either(parted(t), "9-9-9 9:9:9.9", "9-9-9 9:9:9"), lambda _: told(F.col("z")))


def _distinct(cells: _Cells) -> DataFrame:
    """Per column: the exact number of distinct values and shapes, as `profile` has them, of cells that are counted."""
    shapes = cells.rows.select("c", _typed_shape(lambda z: z).alias("z")).groupBy("c", "z").agg(F.count("z").alias("n"))
    counts = shapes.groupBy("c").agg(F.sum("n").alias("distinct_values"), F.count("z").alias("distinct_shapes"))
    return counts.select(cells.named(0).alias("table"), cells.named(1).alias("column"), "distinct_values", "distinct_shapes")


def _sketched(cells: _Cells, accuracy: int) -> DataFrame:
    bit = {k: 1 << i for i, k in enumerate(CLASSES)}
    some = lambda b, k: F.when(b, bit[k]).otherwise(0)
    whole = lambda l: some(l.isin(0, 1), "boolean") + some(l.between(1 - 10**18, 10**18 - 1), "integer")
    told = cells.rows.select(
        "c", "t", "n", F.coalesce(F.col("l").cast("string"), F.col("x").cast("string"), F.substring("s", 1, SHOWN)).alias("p"),
        _by_kind(lambda l: l, F.xxhash64, F.xxhash64, F.xxhash64).alias("value"), _typed_shape(F.xxhash64).alias("shape"),
        _by_kind(whole, lambda _: F.lit(bit["decimal"]), lambda _: F.lit(bit["timestamp"]), lambda _: F.col("m")).alias("m"),
    )
    # a column fits few sets of classes, so these are counted by their rows; unknown cells have none
    sets = told.groupBy("c", "m").agg(
        F.sum("n").alias("n"), F.min("t").cast("string").alias("t0"), F.max("t").cast("string").alias("t1"), F.min("p").alias("p0"), F.max("p").alias("p1"),
        F.hll_sketch_agg("value", accuracy).alias("values"), F.hll_sketch_agg("shape", accuracy).alias("shapes"),
    )
    counts = {"known": F.col("m").isNotNull(), **{f"r_{k}": _has(F.col("m"), k) for k in CLASSES}}
    # the text of times is in their order
    found = sets.groupBy("c").agg(
        F.sum("n").alias("n_rows"), *[F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(k) for k, x in counts.items()],
        F.min(F.least("t0", "p0")).alias("least"), F.max(F.greatest("t1", "p1")).alias("greatest"), F.hll_union_agg("values").alias("values"), F.hll_union_agg("shapes").alias("shapes"),
    )
    nulls = F.col("n_rows") - F.col("known")
    estimate = lambda k: F.when(F.col("known") > 0, F.hll_sketch_estimate(k)).otherwise(0)
    return found.select(
        cells.named(0).alias("table"), cells.named(1).alias("column"), "n_rows", nulls.alias("nulls"), F.round(nulls / F.col("n_rows"), 6).alias("null_rate"), estimate("values").alias("distinct_values"),
        estimate("shapes").alias("distinct_shapes"), "least", "greatest", _classified(F.col("known"), {k: F.col(f"r_{k}") for k in CLASSES}).alias("type"),
    )


def sketch_profile(tables: dict[str, DataFrame], null_spellings: tuple[str, ...], accuracy: int = 14) -> DataFrame:
    """As `profile`, with estimates of the distinct values and shapes and without examples, in one pass over all tables: every
    task keeps a few mergeable sketches of 2 ** accuracy registers a column, and only these are sent. Estimates are off by about
    1.3 / sqrt(2 ** accuracy) of the number; small numbers are exact."""
    return _sketched(_typed_cells(tables, null_spellings, lambda s: s.isNotNull()), accuracy)


def sketches_and_counts(tables: dict[str, DataFrame], null_spellings: tuple[str, ...], accuracy: int = 14) -> tuple[DataFrame, DataFrame]:
    """`sketch_profile`, and the exact distinct values and shapes that its estimates stand for. Whoever counts must bring equal
    cells together; a sketch is the same whether it sees a cell once or often, so here it sees each once, with its number."""
    cells = _counted(tables, null_spellings)
    return _sketched(cells, accuracy), _distinct(cells)


def summarise(profiled: DataFrame) -> DataFrame:
    """Per table: columns, columns with nulls, and the one with most of them (ties to the first name)."""
    return profiled.groupBy("table").agg(F.count(F.lit(1)).alias("n_columns"), F.count_if(F.col("nulls") > 0).alias("with_nulls"), F.min_by("column", F.struct(-F.col("null_rate"), "column")).alias("worst_column"))
