"""Operator 11: audit of how far the word shares of sources diverge, ranked by cells of counts.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. Of each language the terms in at least
`least_docs` of its documents are kept, and every group (language, source) and every language gives each kept term, with
count occurrences there, the share 1 + floor(10^9 (count + 5) / (N + 5 V)); N: its occurrences of kept terms, V: the kept
terms of the language. All of it is whole numbers.

Terms of a group: how much the group's share exceeds the language's depends on the pair (count in the group, count in the
language) alone, so terms are counted by such cells, the difference is taken once a cell, cells with equal differences are
merged, and merged cells are ranked by the terms before them. Only the cells in which a rank up to `ranks` begins are
expanded into terms, in UTF-8 order. No list of a group's terms is ever sorted.

Pairs of sources: the absolute differences are summed over all kept terms. Terms lie in buckets, sources in tiles of about
TILE, and a task holds the shares of one bucket in two tiles; a term that neither source of a pair has adds the difference
of their shares of count 0, which is added once for all V terms and taken back where a term is present.

Defined cases: null texts, languages and sources are read as empty ones; groups without terms take part; a language
without kept terms has pairs of value 0 and no terms; a source alone in its language has no pair; repeated rows are
documents of their own; texts are read whole, one at a time; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import split_join, stored
from siltstone.sources.tables import table

#: What is counted as it is: the letters of terms, upper-case ones as lower-case; all other bytes part terms.
TERM_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Different (group, term) pairs that a task counts before it passes them on.
COUNTED = 400_000
#: Sources of a tile, (group, term) counts of a bucket, and terms that are compared at a time.
TILE, BUCKET_ROWS, CHUNK = 256, 32_768, 2048


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) from (lang, source, text): occurrences and documents of the terms, which are UTF-8; a
    row with an empty term for every group. Tasks add up what they read before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                names = list(terms)
                for i in range(0, len(names), 1 << 16):
                    part = names[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                        + [pa.array(part, pa.binary()), pa.array([total[lang, source][t] for t in part], pa.int64()), pa.array([terms[t] for t in part], pa.int64())],
                        ["lang", "source", "term", "n", "docs"],
                    )
            total.clear()
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("data")):
                words = text.as_py().translate(TERM_BYTES).split()
                of = held.setdefault((lang, source), Counter())
                size -= len(of)
                total.setdefault((lang, source), Counter()).update(words)
                of.update({b"", *words})
                size += len(of)
                if size > COUNTED:
                    yield from counted()
                    size = 0
        yield from counted()

    sent = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    counts = sent.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    # one exchange by (lang, term) serves the sums by group and by language
    return counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (n + 5 v)) as long; null if there is no kept term."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(v > 0, F.floor(F.lit(10**9).cast("decimal(10,0)") * (wide(count) + 5) / (wide(n) + 5 * wide(v))).cast("long") + 1)


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n) of the terms that enough of the language's documents hold, and the rows with an empty
    term."""
    of = Window.partitionBy("lang", "term")
    told = counts.withColumns({"lang_n": F.sum("n").over(of), "lang_docs": F.sum("docs").over(of)})
    kept = told.filter((F.octet_length("term") == 0) | (F.col("lang_docs") >= least_docs))
    return kept.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n")


def group_totals(kept: DataFrame) -> DataFrame:
    """(lang, source, total, kinds, lang_total): N of the group, V and N of its language."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("kinds"), F.sum("lang_n").alias("lang_total"))
    return groups.join(langs, "lang")


def top_terms(kept: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms whose share in the group exceeds that in the language by most."""
    key, cell = ["lang", "source"], ["n", "lang_n"]
    cells = kept.filter("n > 0").groupBy(*key, *cell).agg(F.count(F.lit(1)).alias("held")).join(groups, key)
    value = share(F.col("n"), F.col("total"), F.col("kinds")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))
    valued = stored(cells.withColumn("value", value).filter("value > 0").select(*key, *cell, "held", "value"), "divergence-cells")
    falling = Window.partitionBy(*key).orderBy(F.col("value").desc())
    merged = valued.groupBy(*key, "value").agg(F.sum("held").alias("held")).withColumn("r", F.row_number().over(falling)).filter(F.col("r") <= ranks)
    placed = merged.withColumn("before", F.sum("held").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")).filter(F.col("before") < ranks)
    wanted = stored(valued.select(*key, *cell, "value").join(placed.select(*key, "value", "before"), [*key, "value"]), "divergence-wanted")
    found = split_join(kept.filter("n > 0"), wanted, [*key, *cell])
    inside = found.withColumn("r", F.row_number().over(Window.partitionBy(*key, "value").orderBy("term"))).filter(F.col("r") <= ranks)
    return inside.select(*key, F.col("term").alias("item"), "value", (F.col("before") + F.col("r")).cast("int").alias("rank")).filter(F.col("rank") <= ranks)


def _bucket_pairs(rows: pa.Table) -> pa.Table:
    """(lang, one, other, value) for the pairs of sources of one bucket of terms and two tiles."""
    lang, bucket, low, high = (rows.column(c)[0].as_py() for c in ("lang", "bucket", "low", "high"))
    names, which = np.unique(np.array(rows.column("source").to_pylist(), object), return_inverse=True)
    base, kinds, tile = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for of, c in ((base, "base"), (kinds, "kinds"), (tile, "tile")):
        of[which] = rows.column(c).to_numpy()
    present = rows.column("term").is_valid().to_numpy()
    terms, term = np.unique(np.array(rows.column("term").filter(pa.array(present)).to_pylist(), object), return_inverse=True)
    p, who = rows.column("p").to_numpy()[present], which[present]
    order = np.argsort(term, kind="stable")
    term, p, who = term[order], p[order], who[order]
    sums = np.zeros((len(names), len(names)), np.int64)
    for i in range(0, len(terms), CHUNK):
        a, b = np.searchsorted(term, [i, i + CHUNK])
        shares = np.repeat(base[:, None], min(CHUNK, len(terms) - i), axis=1)
        shares[who[a:b], term[a:b] - i] = p[a:b]
        for j in range(len(names) - 1):
            sums[j, j + 1 :] += np.abs(shares[j + 1 :] - shares[j]).sum(axis=1)
    sums += np.abs(base[None] - base[:, None]) * ((kinds if bucket == 0 else 0) - len(terms))
    one, other = np.triu_indices(len(names), 1)
    of = (np.minimum(tile[one], tile[other]) == low) & (np.maximum(tile[one], tile[other]) == high)
    one, other = one[of], other[of]
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "one": pa.array(names[one].tolist(), pa.string()), "other": pa.array(names[other].tolist(), pa.string()), "value": pa.array(sums[one, other])})


def _numbers(n: int) -> Column:
    """0 to n - 1 as longs."""
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language, the most different first."""
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 1
    tiles, buckets = math.ceil(most / TILE), math.ceil(max(1, kept.count()) / BUCKET_ROWS)
    based = groups.withColumn("base", F.coalesce(share(F.lit(0), F.col("total"), F.col("kinds")), F.lit(0))).withColumn("tile", F.pmod(F.xxhash64("source"), F.lit(tiles)))
    named = ["lang", "source", "kinds", "base", "tile"]
    told = split_join(kept.filter("term <> ''").select("lang", "source", "term", "n"), based, ["lang", "source"])
    terms = told.select(*named, F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), "term", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"))
    alone = based.select(*named, F.explode(_numbers(buckets)).alias("bucket"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))
    both = terms.unionByName(alone).withColumn("with", F.explode(_numbers(tiles)))
    laid = both.withColumns({"low": F.least("tile", "with"), "high": F.greatest("tile", "with")}).drop("with")
    partial = laid.groupBy("lang", "bucket", "low", "high").applyInArrow(_bucket_pairs, "lang string, one string, other string, value long")
    summed = partial.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return summed.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value").withColumn("rank", ranked)


def audit_sources(docs: DataFrame, least_docs: int = 30, ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) from (text, lang, source): of every group of a language and a source, the
    other sources by divergence (part `pair`) and the terms that it has too much of (part `term`, `ranks` of them)."""
    kept = stored(kept_terms(term_counts(docs), least_docs), "divergence-terms")
    groups = stored(group_totals(kept), "divergence-groups")
    parts = (("pair", source_pairs(kept, groups)), ("term", top_terms(kept, groups, ranks)))
    pairs, terms = (df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in parts)
    return pairs.unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents: terms in at least 30 documents of their language, ranks up to 50."""
    return audit_sources(table(spark, sf_dir, "documents"))


_ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+') AS terms
  FROM documents),
w AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(k.term) AS v, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS c, 1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 5)) // (g.n::HUGEINT + 5 * v.v) AS p,
    1 + (1000000000 * (k.n::HUGEINT + 5)) // (v.n::HUGEINT + 5 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLES = {"op11_source_divergence": _ORACLE}
