"""Operator 2: mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source has a target number of words. Of all rates w >= 0 for a source's documents with sum(w * size) = target and
w <= cap, the ones nearest to 1 in relative entropy are w = min(cap, exp(lambda * z)), z being the size over the
source's mean. lambda is the dual variable of the source's word constraint; Newton's method, kept inside a bracket,
finds it for all sources at once: every iteration is one aggregation over the (source, size) counts, whose integer sums
do not depend on the order of rows. Rates become copies per (source, size) by cumulative rounding, then the sizes
whose change leaves least take up the difference to the target. Which of equal-sized documents get one copy
more is decided by the order of a hash of their doc_id, numbered in buckets so that no task holds a large group.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 get the
copies that their rate of 1 gives and take no words; equal rows (doc_id, source, size) are counted first and get
their own numbers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import stored, word_count
from siltstone.sources.tables import table

#: Newton iterations (ten are usual), after which brackets are halved until they close. Relative error of a source's words
#: at which it is settled.
ITERATIONS, SETTLED = 60, 1e-6
#: Units of a word in which sums are taken, so that they are sums of integers.
UNIT = 1e6
#: Passes that take up what rounding has left between looks whether any source can still be mended, and documents of one size numbered by one task.
REPAIRS, PER_BUCKET = 6, 1024


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Per __source: source_size, target. sizes: (__source, source_size), a row for each source.

    A target is min(cap * source_size, level * weight) for the one level at which targets sum up to all sizes. The level
    starts at what all sources share; each round takes out the sources above their cap and shares the rest by weight,
    until none is above; a round is one aggregation, of which the driver gets one row. Sources are numbered by their
    places in a sorted table, so no task holds them all.
    """
    in_order = stored(sizes.orderBy("__source"), "mix-sources")
    placed = in_order.select("__source", "source_size", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__rows"))
    starts = files.select("__file", (F.sum("__rows").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__rows")).alias("__start"))
    number = (F.col("__start") + F.col("__row")) % len(weights)
    weighted = placed.join(starts, "__file").select("__source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), number.cast("int")).alias("__w"), (F.lit(cap) * F.col("source_size")).alias("__cap"))
    weighted = stored(weighted, "mix-weights")
    total = weighted.agg(F.sum("source_size").cast("double").alias("s"), F.sum("__w").alias("w")).first()
    level, below = (total.s or 0.0) / (total.w or 1.0), -1
    while True:
        over = F.col("__cap") < F.lit(level) * F.col("__w")
        got = weighted.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("__cap")).otherwise(0.0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("__w"))).alias("w")).first()
        if got.n == below or not got.w:
            break
        level, below = (total.s - got.capped) / got.w, got.n
    return weighted.select("__source", "source_size", F.least(F.col("__cap"), F.lit(level) * F.col("__w")).cast("double").alias("target"))


def _newton(counts: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Per __source: target, __mean, __lambda (null where every rate is the cap)."""
    means = counts.groupBy("__source").agg((F.sum(F.col("__n") * F.col("__size") * F.col("__size")).cast("double") / F.sum(F.col("__n") * F.col("__size"))).alias("__mean"))
    ratio = F.col("target") / F.col("source_size")
    state = targets.filter("source_size > 0").join(means, "__source").select(
        "__source", "target", "source_size", "__mean",
        F.lit(0.0).alias("__lambda"),
        F.when(ratio < 1, F.col("__mean") * F.log(ratio)).otherwise(0.0).alias("__lo"),
        F.when(ratio > 1, F.col("__mean") * math.log(cap)).otherwise(0.0).alias("__hi"),
        (ratio >= cap * (1 - 1e-12)).alias("__full"),
        ((F.abs(ratio - 1) <= SETTLED) | (ratio >= cap * (1 - 1e-12))).alias("__done"),
    )
    state = stored(state, "mix-dual")
    for i in count():
        if state.filter("NOT __done").isEmpty():
            break
        z = F.col("__size") / F.col("__mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("__lambda") * z, F.lit(700.0))))
        units = lambda x: F.sum(F.round(x * UNIT).cast("decimal(30,0)")).cast("double") / UNIT
        words = F.col("__n") * F.col("__size")
        sums = counts.join(state.filter("NOT __done").select("__source", "__mean", "__lambda"), "__source").groupBy("__source").agg(
            units(words * rate).alias("__f"), units(F.when(rate < cap, words * z * rate).otherwise(0.0)).alias("__slope")
        )
        low = F.col("__f") < F.col("target")
        lo, hi = F.when(low, F.col("__lambda")).otherwise(F.col("__lo")), F.when(low, F.col("__hi")).otherwise(F.col("__lambda"))
        step = F.col("__lambda") + (F.log("target") - F.log("__f")) * F.try_divide(F.col("__f"), F.col("__slope"))
        inside = F.lit(i < ITERATIONS) & step.isNotNull() & ~F.isnan(step) & (step > lo) & (step < hi)
        done = F.col("__done") | (F.abs(F.col("__f") / F.col("target") - 1) <= SETTLED) | (hi - lo <= 1e-13 * F.greatest(F.abs(lo), F.abs(hi)))
        state = stored(state.join(sums, "__source", "left").select(
            "__source", "target", "source_size", "__mean",
            F.when(F.coalesce(done, F.lit(True)), F.col("__lambda")).when(inside, step).otherwise((lo + hi) / 2).alias("__lambda"),
            F.when(F.col("__f").isNull(), F.col("__lo")).otherwise(lo).alias("__lo"),
            F.when(F.col("__f").isNull(), F.col("__hi")).otherwise(hi).alias("__hi"),
            "__full", F.coalesce(done, F.lit(True)).alias("__done"),
        ), "mix-dual")
    return state.select("__source", "target", "__mean", F.when(~F.col("__full"), F.col("__lambda")).alias("__lambda"))


def _copies_by_size(counts: DataFrame, dual: DataFrame, cap: float) -> DataFrame:
    """Per (__source, __size): __n documents and the __m copies that they get together."""
    most = int(math.floor(cap))
    rate = F.when(F.col("__lambda").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("__lambda") * F.col("__size") / F.col("__mean"), F.lit(700.0)))))
    source = Window.partitionBy("__source")
    down = source.orderBy(F.desc("__size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    micro = F.round(F.col("__n") * F.least(rate, F.lit(float(most))) * UNIT).cast("long")
    rounded = lambda x: F.floor((x + int(UNIT / 2)) / UNIT)
    out = counts.join(dual, "__source").withColumn("__micro", micro).withColumn("__up_to", F.sum("__micro").over(down))
    out = out.withColumn("__m", (rounded(F.col("__up_to")) - rounded(F.col("__up_to") - F.col("__micro"))).cast("long"))
    while True:
        for _ in range(REPAIRS):
            out = out.withColumn("__left", F.col("target") - F.sum(F.col("__m") * F.col("__size")).over(source))
            room = F.when(F.col("__left") > 0, most * F.col("__n") - F.col("__m")).otherwise(F.col("__m"))
            steps = F.least(room, F.greatest(F.lit(1), F.round(F.abs("__left") / F.col("__size"))))
            rest = F.abs(F.abs("__left") - steps * F.col("__size"))
            out = out.withColumn("__steps", F.signum("__left") * steps)
            # the one size whose change leaves least, if that is less than now
            out = out.withColumn("__pick", F.min(F.when((room > 0) & (rest < F.abs("__left")), F.struct(rest.alias("rest"), F.col("__size").alias("size")))).over(source))
            out = out.withColumn("__m", (F.col("__m") + F.when(F.col("__size") == F.col("__pick.size"), F.col("__steps")).otherwise(0)).cast("long"))
        out = stored(out, "mix-copies")
        if out.filter("__pick IS NOT NULL").isEmpty():
            return out.select("__source", "__size", "__n", "__m", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (0 to cap), taken (copies * size).

    Sources in code point order, null last, have the weights in turn and share the words of all documents; no target is
    above cap times its source's words.
    """
    rows = stored(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t")).alias("__source"), word_count(F.col(text)).alias("__size"),
    ), "mix-sizes")
    counts = rows.groupBy("__source", "__size").agg(F.count(F.lit(1)).alias("__n"))
    targets = stored(source_targets(counts.groupBy("__source").agg(F.sum(F.col("__n") * F.col("__size")).alias("source_size")), weights, cap), "mix-targets")
    filled = stored(counts.filter("__size > 0"), "mix-counts")
    by_size = _copies_by_size(filled, _newton(filled, targets, cap), cap)

    equal = rows.groupBy("doc_id", "source", "__source", "__size").agg(F.count(F.lit(1)).alias("__equal"))
    found = equal.join(by_size.drop("target"), ["__source", "__size"], "left").withColumn("__hash", F.xxhash64("doc_id", F.lit("mix")))
    base = F.coalesce(F.floor(F.col("__m") / F.col("__n")), F.lit(1)).cast("long")
    found = found.withColumn("__base", base).withColumn("__extra", F.coalesce(F.col("__m") - F.col("__base") * F.col("__n"), F.lit(0)).cast("long"))
    found = found.withColumn("__bucket", F.when(F.col("__extra") > 0, F.pmod(F.col("__hash"), F.greatest(F.lit(1), F.ceil(F.col("__n") / PER_BUCKET)))).otherwise(-1 - F.pmod(F.col("__hash"), F.lit(1024))))
    keys = ["__source", "__size", "__bucket"]
    in_order = Window.partitionBy("__source", "__size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = found.filter("__extra > 0").groupBy(*keys).agg(F.sum("__equal").alias("__sum")).withColumn("__start", F.sum("__sum").over(in_order) - F.col("__sum")).drop("__sum")
    inside = Window.partitionBy(*keys).orderBy("__hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = found.filter("__extra > 0").join(starts, keys).withColumn("__first", F.col("__start") + F.sum("__equal").over(inside) - F.col("__equal"))
    more = F.greatest(F.lit(0), F.least(F.col("__extra") - F.col("__first"), F.col("__equal")))
    columns = ["doc_id", "source", "__source", "__size", "__equal", "__base"]
    dealt = some.select(*columns, more.cast("long").alias("__more")).unionByName(found.filter("__extra = 0").select(*columns, F.lit(0).cast("long").alias("__more")))
    single = dealt.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__equal"))))
    copies = F.col("__base") + F.when(F.col("__i") <= F.col("__more"), 1).otherwise(0)
    return single.join(targets, "__source").select(
        "doc_id", "source", F.col("__size").alias("size"), "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("__size")).cast("long").alias("taken"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 1, 2, 3 in turn and targets of 3 times a source at most."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLES: dict[str, str] = {}
