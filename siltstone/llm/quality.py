"""Operator 6: quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is over the bytes of the text in UTF-8, of order ORDER, so it has every script; a run of ASCII white space is
one space, and a text begins after spaces. Tasks count the n-grams of their trusted texts, Spark adds the counts up;
lower orders count distinct left neighbours. Per order, the count table is joined with its contexts' totals and with the
probabilities of the next lower order, all dealt out by their keys, which gives the interpolated probability of every
n-gram seen and the back-off weight of every context seen.

Scoring looks up the n-grams of whole texts. The model's tables are broadcast if they have at most `broadcast_rows` rows;
else documents are dealt to blocks of about BLOCK_BYTES of text, the distinct n-grams of each block are joined with the
tables order by order, and each block is put together with its own n-grams. Both ways give the same scores.

A document is kept if its perplexity is at most its threshold, the `quantile` of the perplexities of all trusted documents
of its language, to a thousandth of a nat. Trusted documents are dealt to `folds` by a hash of the doc_id, and for the
thresholds each fold is scored by the model of the others, so that what a model has learned by heart does not lower
them. All documents are scored by the model of all trusted text.

Defined cases: a null or empty text has perplexity null and is not kept; a text of white space only is one symbol; texts
are read whole, in parts; a null language is a language of its own; a language without trusted documents that have a
symbol has threshold null and keeps what has symbols; without trusted text at all every byte is equally likely; a
document with several labels is trusted if none is against it, null labels and labels without a doc_id count for
nothing; documents without a doc_id are never trusted; repeated rows are each scored; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import stored
from siltstone.sources.tables import table

ORDER, SYMBOLS = 5, 256
#: Bytes of a text that are turned into n-grams at a time, and n-grams that are counted at a time.
PART, COUNTED = 1 << 20, 1 << 22
#: Least log probability of a byte; discounts may be 0, and what was never seen then has none.
FLOOR = math.log(1e-7)
#: Rows of the model's tables (about 16 bytes each) that are broadcast at most; text of a block beyond that.
BROADCAST_MODEL, BLOCK_BYTES = 6_000_000, 1 << 24
#: Trusted doc_ids and thresholds that are broadcast at most; beyond them texts are shuffled to the labels.
BROADCAST_ROWS = 1_000_000
#: Thousandths of a nat are the unit in which quantiles are taken.
UNITS = 1000
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))


def grams(text: str | None) -> Iterator[np.ndarray]:
    """The codes of the ORDER-grams that end at each symbol of a text, in parts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    carry, first = np.full(ORDER - 1, 32, np.int64), True
    for at in range(0, len(data), PART):
        s = np.frombuffer(data, np.uint8, min(PART, len(data) - at), at)
        space = SPACES[s]
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] = keep[0] or first or carry[-1] != 32
        s, first = np.concatenate((carry, np.where(space, 32, s)[keep].astype(np.int64))), False
        codes = s[: len(s) - ORDER + 1].copy()
        for i in range(1, ORDER):
            codes <<= 8
            codes |= s[i : len(s) - ORDER + 1 + i]
        carry = s[len(s) - ORDER + 1 :]
        yield codes


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    return (x.as_py() for x in batch.column("text"))


def count_grams(trusted: DataFrame, folds: int) -> DataFrame:
    """(model, gram, c) from (fold, text): how often each ORDER-gram occurs, for model i in all folds but fold i, for model
    number `folds` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for fold, codes in held.items():
                found, n = np.unique(np.concatenate(codes), return_counts=True)
                for i in range(0, len(found), 1 << 16):
                    part = found[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"fold": pa.array(np.full(len(part), fold, np.int32)), "gram": pa.array(part), "c": pa.array(n[i : i + (1 << 16)])})
            held.clear()
            size = 0

        for batch in batches:
            for fold, text in zip(batch.column("fold").to_pylist(), _texts(batch)):
                for codes in grams(text):
                    held.setdefault(fold, []).append(codes)
                    size += len(codes)
                    if size > COUNTED:
                        yield from counted()
        yield from counted()

    counts = trusted.select("fold", "text").mapInArrow(run, "fold int, gram long, c long").groupBy("fold", "gram").agg(F.sum("c").alias("c"))
    models = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda m: m != F.col("fold")))
    return counts.withColumn("model", models).groupBy("model", "gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(model, d1, d2, d3): the discounts of modified Kneser-Ney from the counts of counts 1 to 4; 0 where they are not
    defined. A row for each model."""
    n = counts.groupBy("model").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.0))
    some = [F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.0)) for i in (1, 2, 3)]
    return n.select("model", *[F.greatest(F.lit(0.0), F.least(F.lit(float(i)), d)).alias(f"d{i}") for i, d in enumerate(some, 1)])


def model_tables(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from 1 to ORDER: (model, gram, p) for every n-gram seen and (model, context, backoff) for every context
    seen, from counts (model, gram, c) of the highest order."""
    of = {ORDER: stored(counts, "kn-counts")}
    for n in range(ORDER - 1, 0, -1):
        of[n] = stored(of[n + 1].groupBy("model", F.col("gram").bitwiseAND((1 << (8 * n)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "kn-counts")
    out, lower = [], None
    for n in range(1, ORDER + 1):
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = of[n].join(F.broadcast(_discounts(of[n])), "model").withColumn("d", off).withColumn("context", F.shiftright("gram", 8))
        weights = stored(rows.groupBy("model", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("backoff")), "kn-weights")
        joined = rows.join(weights, ["model", "context"]).withColumn("lower_gram", F.col("gram").bitwiseAND((1 << (8 * (n - 1))) - 1))
        if lower is None:
            joined = joined.withColumn("lower_p", F.lit(1.0 / SYMBOLS))
        else:
            joined = joined.join(lower.select("model", F.col("gram").alias("lower_gram"), F.col("p").alias("lower_p")), ["model", "lower_gram"])
        lower = stored(joined.select("model", "gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("backoff") * F.col("lower_p")).alias("p")), "kn-probabilities")
        out.append((lower, weights.select("model", "context", "backoff")))
    return out


def joined_scores(asked: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """asked (model, gram) with logp, the log probability of the last byte of the n-gram after the others."""
    p = asked.withColumn("q", F.lit(1.0 / SYMBOLS))
    for n, (seen, weights) in enumerate(tables, 1):
        p = p.withColumn("g", F.col("gram").bitwiseAND((1 << (8 * n)) - 1)).withColumn("context", F.shiftright("g", 8))
        p = p.join(weights, ["model", "context"], "left").join(seen.withColumnRenamed("gram", "g"), ["model", "g"], "left")
        p = p.select("model", "gram", F.coalesce("p", F.coalesce("backoff", F.lit(1.0)) * F.col("q")).alias("q"))
    return p.select("model", "gram", F.greatest(F.log("q"), F.lit(FLOOR)).alias("logp"))


class Lookup:
    """The tables of one model as sorted arrays."""

    def __init__(self, orders: list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]):
        self.orders = orders

    @staticmethod
    def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the wanted keys and whether they are there."""
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        out, factor, left = np.empty(len(codes)), np.ones(len(codes)), np.arange(len(codes))
        for n in range(len(self.orders), 0, -1):
            (seen, p), (contexts, backoff) = self.orders[n - 1]
            part = codes[left] & ((1 << (8 * n)) - 1)
            at, found = self._at(seen, part)
            out[left[found]] = factor[left[found]] * p[at[found]]
            left, part = left[~found], part[~found]
            if not len(left):
                break
            at, found = self._at(contexts, part >> 8)
            factor[left[found]] *= backoff[at[found]]
        out[left] = factor[left] / SYMBOLS
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(out), FLOOR)


def collected(tables: list[tuple[DataFrame, DataFrame]], folds: int) -> list[Lookup]:
    """The tables of all models on the driver; their size has been checked."""
    parts = []
    for pair in tables:
        for rows, key, value in zip(pair, ("gram", "context"), ("p", "backoff")):
            got = rows.select("model", key, value).toArrow()
            model, keys, values = (got.column(c).to_numpy() for c in ("model", key, value))
            order = np.lexsort((keys, model))
            cuts = np.searchsorted(model[order], np.arange(folds + 2))
            parts.append([(keys[order[a:b]], values[order[a:b]]) for a, b in zip(cuts, cuts[1:])])
    return [Lookup([(parts[2 * n][m], parts[2 * n + 1][m]) for n in range(len(tables))]) for m in range(folds + 1)]


def _mean(text: str | None, log_probabilities) -> tuple[int, float | None]:
    total, n = 0.0, 0
    for codes in grams(text):
        total += float(log_probabilities(codes).sum())
        n += len(codes)
    return n, -total / n if n else None


CARRIED = ("doc_id", "lang", "lang_key", "model")
SCORED = "doc_id long, lang string, lang_key string, model int, n_symbols long, nats double"


def _scored(rows: pa.RecordBatch | pa.Table, found: list[tuple[int, float | None]]) -> dict:
    return {c: rows.column(c) for c in CARRIED} | {"n_symbols": pa.array([n for n, _ in found], pa.int64()), "nats": pa.array([x for _, x in found], pa.float64())}


def score_by_broadcast(docs: DataFrame, lookups) -> DataFrame:
    """SCORED for docs (CARRIED, text); lookups: a broadcast of a Lookup for each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = batch.column("model").to_pylist()
            yield pa.RecordBatch.from_pydict(_scored(batch, [_mean(t, lookups.value[m].log_probabilities) for m, t in zip(models, _texts(batch))]))

    return docs.mapInArrow(run, SCORED)


def score_by_blocks(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """SCORED for docs (CARRIED, text), by joins of the n-grams of blocks of documents with the tables."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    placed = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.lit("block")), F.lit(max(1, math.ceil(size / block_bytes)))))

    def ask(rows: pa.Table) -> pa.Table:
        codes, held = np.empty(0, np.int64), []
        for text in rows.column("text"):
            for part in grams(text.as_py()):
                held.append(part)
                if sum(map(len, held)) > COUNTED:
                    codes, held = np.unique(np.concatenate([codes, *held])), []
        codes = np.unique(np.concatenate([codes, *held]))
        one = lambda c, t: pa.array([rows.column(c)[0].as_py()] * len(codes), t)
        return pa.table({"model": one("model", pa.int32()), "block": one("block", pa.int64()), "gram": pa.array(codes)})

    asked = stored(placed.groupBy("model", "block").applyInArrow(ask, "model int, block long, gram long"), "kn-asked")
    told = stored(joined_scores(asked.select("model", "gram").distinct(), tables), "kn-told")
    answers = asked.join(told, ["model", "gram"])

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        keys, values = told.column("gram").to_numpy(), told.column("logp").to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        found = [_mean(t.as_py(), lambda codes: values[np.searchsorted(keys, codes)]) for t in rows.column("text")]
        return pa.table(_scored(rows, found))

    return placed.groupBy("model", "block").cogroup(answers.groupBy("model", "block")).applyInArrow(score, SCORED)


def _thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang_key, limit): the upper end, in UNITS of a nat, of the bucket that the quantile of each language falls into."""
    buckets = scored.filter("nats IS NOT NULL").groupBy("lang_key", F.floor(F.col("nats") * UNITS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy("lang_key")
    up = F.sum("n").over(per.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = buckets.withColumn("up", up).withColumn("all", F.sum("n").over(per))
    return ranked.filter(F.col("up") >= F.col("all") * quantile).groupBy("lang_key").agg((F.min("bucket") + 1).alias("limit"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, folds: int = 2, broadcast_rows: int = BROADCAST_MODEL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, keep for every row of docs (doc_id, text, lang).

    labels: (doc_id, quality); documents of quality 1 are trusted.
    """
    spark = docs.sparkSession
    good = stored(labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).filter("q = 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("trusted")), "trusted")
    near = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    language = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), language.alias("lang_key"))
    rows = rows.join(near, "doc_id", "left").withColumn("fold", F.when(F.coalesce("trusted", F.lit(False)), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds))).cast("int"))
    tables = model_tables(count_grams(rows.filter("fold IS NOT NULL"), folds))
    # every document by the model of all, the trusted ones by the model of the other folds too
    models = F.explode(F.when(F.col("fold").isNull(), F.array(F.lit(folds))).otherwise(F.array(F.lit(folds), F.col("fold"))))
    asked = rows.withColumn("model", models)
    if sum(t.count() for pair in tables for t in pair) <= broadcast_rows:
        lookups = spark.sparkContext.broadcast(collected(tables, folds))
        scored = score_by_broadcast(asked.select(*CARRIED, "text"), lookups)
    else:
        scored = score_by_blocks(asked.select(*CARRIED, "text"), tables, block_bytes)
    scored = stored(scored, "scored")
    limits = stored(_thresholds(scored.filter(F.col("model") < folds), quantile), "limits")
    out = scored.filter(F.col("model") == folds).join(F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits, "lang_key", "left")
    most = F.col("limit") / UNITS
    keep = F.col("nats").isNotNull() & F.coalesce(F.col("nats") <= most, F.lit(True))
    return out.select("doc_id", "lang", "n_symbols", F.exp("nats").alias("perplexity"), F.exp(most).alias("threshold"), keep.alias("keep"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of all documents of quality 1, and whether it is kept."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
