"""Operator 13: runs of periodic words by recursive frequency splitting and a scan of lags.

A run is a stretch of consecutive words with smallest period q, of at least LEAST words and REPEATS periods, that no
neighbouring word extends. Every word of a run occurs REPEATS times in it, so a word that occurs more rarely within the
current segment is in none and splits the segment; the pieces are counted again until nothing splits. The segments of
all texts of a batch go through this side by side.

What survives is scanned lag by lag: words that equal the word q later, in stretches that are long enough. Lags below
DIRECT are compared at every place. For the lags of [b, 2b), b a power of two, blocks of b words at multiples of b are
compared with the blocks that start b to 2b words later, by hashes: a run of such a period holds one of them and its
repetition; a hit is then followed word by word in both directions. So a segment of n words takes n log n comparisons, and
equal hashes decide nothing. Of stretches, those that have a smaller period are left out.

Defined cases: null, empty and short texts have no run and collapse to their words; a text of any length is read whole, by
one task; repeated rows are each told; an empty table gives an empty one; other columns are carried, but for those that
have the names of the results, which are replaced. Texts need not be valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import MULTIPLIER, WORD, further, spare
from siltstone.sources.tables import table

#: Least words of a run, and least periods in it.
LEAST, REPEATS = 24, 3
#: Lags below this, a power of two, are scanned place by place.
DIRECT = 64
#: Words of several texts that are searched together.
TOGETHER = 500_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def surviving(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments [lo, hi) of ids that are left when no word is too rare in its segment."""
    done, wide = [(lo[:0], hi[:0])], int(ids.max(initial=0)) + 1
    while True:
        long = hi - lo >= LEAST
        lo, hi = lo[long], hi[long]
        if not len(lo):
            return tuple(np.concatenate(x) for x in zip(*done))
        size = hi - lo
        segment = np.repeat(np.arange(len(lo)), size)
        begins = np.cumsum(size) - size
        at = np.arange(len(segment)) + np.repeat(lo - begins, size)
        _, which, counts = np.unique(segment * wide + ids[at], return_inverse=True, return_counts=True)
        common = counts[which] >= REPEATS
        stable = np.logical_and.reduceat(common, begins)
        done.append((lo[stable], hi[stable]))
        common &= ~stable[segment]
        before, after = np.zeros_like(common), np.zeros_like(common)
        before[1:], after[:-1] = common[:-1], common[1:]
        before[begins] = after[begins + size - 1] = False
        lo, hi = at[common & ~before], at[common & ~after] + 1


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of True begin and end."""
    edges = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def smaller_period(w: np.ndarray, period: int) -> bool:
    """Whether words of this period (three of them at least) have a smaller one, which then divides it."""
    rest, divisors, d = period, [], 2
    while d * d <= rest:
        if rest % d == 0:
            divisors.append(d)
            while rest % d == 0:
                rest //= d
        d += 1
    divisors += [rest] if rest > 1 else []
    return any(np.array_equal(w[period // d : 2 * period], w[: 2 * period - period // d]) for d in divisors)


def short_lags(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The runs (start, length, period) of periods below DIRECT in the segments."""
    least, size = 1, 0
    for q in range(1, DIRECT):
        if q == least:  # segments too short for these lags are left behind
            least, wanted = 2 * q, hi - lo >= max(LEAST, REPEATS * q)
            lo, hi = lo[wanted], hi[wanted]
            size = hi - lo + 1
            begins = np.cumsum(size) - size
            at = np.arange(size.sum()) + np.repeat(lo - begins, size)
            x = np.where(at < np.repeat(hi, size), ids[np.minimum(at, len(ids) - 1)], -at - 1)
        if not len(lo):
            return
        first, last = stretches(x[:-q] == x[q:])
        for i in np.flatnonzero(last - first >= max(LEAST, REPEATS * q) - q).tolist():
            a, length = int(first[i]), int(last[i] - first[i]) + q
            if not smaller_period(x[a : a + length], q):
                yield int(at[a]), length, q


def agreement(x: np.ndarray, y: np.ndarray) -> int:
    """How many words x and y have in common from their beginnings."""
    at, step, n = 0, 64, min(len(x), len(y))
    while at < n:
        differ = x[at : min(n, at + step)] != y[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + len(differ), 2 * step
    return n


def long_lags(w: np.ndarray, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """known (the runs of periods below DIRECT of the segment w), and the runs of longer periods."""
    found, n, b = list(known), len(w), DIRECT
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, MULTIPLIER))), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))))), dtype=np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(further(w.astype(np.uint64), 1) * powers[:n], dtype=np.uint64)))
    while REPEATS * b <= n:
        hashes = (sums[b:] - sums[:-b]) * inverse[: n - b + 1]
        reach = np.zeros(n, np.int64)
        for start, length, _ in found:
            reach[start] = max(reach[start], start + length)
        reach = np.maximum.accumulate(reach)
        later = np.arange(b, len(hashes))
        anchor = (later // b - 1) * b
        # what lies within a run of a smaller period has no other smallest period
        hits = np.flatnonzero((hashes[later] == hashes[anchor]) & (reach[anchor] < later + b))
        lags, anchors = later[hits] - anchor[hits], anchor[hits]
        end = {}
        for i in np.lexsort((anchors, lags)).tolist():
            q, s = int(lags[i]), int(anchors[i])
            if s < end.get(q, 0):
                continue
            right = agreement(w[s : n - q], w[s + q :])
            left = agreement(w[:s][::-1], w[q : s + q][::-1])
            start, length = s - left, left + right + q
            end[q] = max(s + right, s + 1)
            if length >= REPEATS * q and not smaller_period(w[start : start + length], q):
                found.append((start, length, q))
        b *= 2
    return found


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words, by start and period."""
    numbers = count()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known[w] if w in known else known.setdefault(w, next(numbers)) for words in texts for w in words), np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    lo, hi = surviving(ids, begins, begins + sizes)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    by_segment: dict[int, list] = {}
    for run in short_lags(ids, lo, hi):
        by_segment.setdefault(int(np.searchsorted(lo, run[0], side="right")) - 1, []).append(run)
    for i in np.flatnonzero(hi - lo >= REPEATS * DIRECT).tolist():
        a = int(lo[i])
        by_segment[i] = [(s + a, length, q) for s, length, q in long_lags(ids[a : hi[i]], [(s - a, length, q) for s, length, q in by_segment.get(i, [])])]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, runs in by_segment.items():
        k = int(np.searchsorted(begins, lo[i], side="right")) - 1
        out[k] += [(s - int(begins[k]), length, q) for s, length, q in runs]
    return [sorted(set(runs), key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """`docs` with all runs of the text (an array of start, length, period, in words, by start and period) and the text
    without repetitions. Nothing is shuffled."""
    rest = docs.drop(*[c for c in (runs, collapsed) if c != text])
    (data,) = spare(rest, "data")
    sent = rest.withColumn(data, F.col(text).cast("binary"))
    sent = sent.drop(text)
    schema = sent.drop(data).withColumn(runs, F.lit(None).cast("array<struct<start:long,length:long,period:long>>")).withColumn(collapsed, F.lit(None).cast("binary")).withColumn(data, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, short, held, n = [], [], [], 0
            texts = batch.column(data)
            for i in range(batch.num_rows):
                held.append((texts[i].as_py() or b"").split())
                n += len(held[-1])
                if n >= TOGETHER or i == batch.num_rows - 1:
                    each = find_runs(held)
                    short += map(collapse, held, each)
                    found += [[{"start": s, "length": length, "period": q} for s, length, q in x] for x in each]
                    held, n = [], 0
            columns = {name: batch.column(name) for name in batch.schema.names if name != data}
            yield pa.RecordBatch.from_pydict(columns | {runs: pa.array(found, pa.list_(RUN)), collapsed: pa.array(short, pa.binary()), data: texts})

    out = sent.mapInArrow(run, schema)
    if text in (runs, collapsed):
        return out.withColumn(collapsed, F.col(collapsed).cast("string")).drop(data)
    return out.select(*[F.col(data).cast("string").alias(c) if c == text else F.col(c) for c in rest.columns], runs, F.col(collapsed).cast("string").alias(collapsed))


def best_run(runs: Column) -> Column:
    """The run with the greatest exact length / period, of equal ones the first by start and period."""
    better = lambda x, y: (x.isNull()) | (y["length"] * x["period"] > x["length"] * y["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda x, y: F.when(better(x, y), y).otherwise(x))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text), the texts of about a tenth of the documents made periodic from some word on: word i >= a becomes word
    a + (i - a) % p. A null doc_id leaves its text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words").cast("long")
    placed = some.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), times)), F.lit(1), (n - F.col("a")).cast("int"))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which a tenth are made periodic first; digests of all runs and of the collapsed text."""
    told = periodic_runs(with_repeats(table(spark, sf_dir, "documents"))).withColumn("best", best_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *best,
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _oracle() -> str:
    digits = "doc_id::VARCHAR"
    eight = " || ".join(f"' ' || lead(v, {i}) OVER r" for i in range(1, 8))
    return f"""
WITH t AS (
  SELECT list(v ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v
    FROM range(256) r(n))),
d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o,
    xor(list_reduce(list_transform(range(strlen({digits})), lambda i: ascii(substr({digits}, i::INT + 1, 1))::BIGINT),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM documents, t),
e AS (SELECT *, len(o) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
x AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: o[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END)::BIGINT + 1]) ELSE o END AS w FROM q),
words AS (SELECT doc_id, n, unnest(w) AS v, unnest(range(n)) AS i FROM x),
g8 AS (SELECT doc_id, n, i, v || {eight} AS v FROM words WHERE n >= 24 WINDOW r AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT l.doc_id, l.i, r.i - l.i AS lag FROM g8 l JOIN g8 r ON l.doc_id = r.doc_id AND l.v = r.v AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
isles AS (SELECT doc_id, lag, min(i) AS s, count(*) + 7 + lag AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS isle FROM pairs) GROUP BY doc_id, lag, isle),
long AS (SELECT * FROM isles WHERE l >= 24 AND l >= 3 * lag),
runs AS (SELECT * FROM long y WHERE NOT EXISTS (FROM long z WHERE z.doc_id = y.doc_id AND z.lag < y.lag AND z.s <= y.s AND z.s + z.l >= y.s + y.l)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + lag, s + l)) AS i FROM runs),
kept AS (SELECT x.doc_id, coalesce(c, '') AS c FROM x LEFT JOIN (
  SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS c FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id) USING (doc_id)),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s::VARCHAR || ',' || l::VARCHAR || ',' || lag::VARCHAR || chr(10), '' ORDER BY s, lag) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT y.* FROM runs y WHERE NOT EXISTS (FROM runs z WHERE z.doc_id = y.doc_id AND (z.l * y.lag > y.l * z.lag OR (z.l * y.lag = y.l * z.lag AND (z.s, z.lag) < (y.s, y.lag)))))
SELECT x.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, lag::BIGINT AS period, (1000 * l // lag)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(c) AS collapsed_sha256
FROM x JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN best ON best.doc_id = x.doc_id
"""


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op13_periodic_runs": _oracle()}
