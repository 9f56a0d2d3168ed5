"""Operator 8: benchmark decontamination by greedy string tiling.

Tokens are lower-cased words with ASCII punctuation taken as white space. Seeds are the `least` consecutive tokens of a
benchmark item. A bit table of the seeds, of bounded size, goes to the tasks that read documents; the few places that
pass it are joined with the seeds themselves, which gives the (document, item) pairs with shared seeds. A document's
tokens at its shared seeds are all that matches of `least` tokens can consist of, so the text is not needed again.

For each pair, greedy string tiling marks longest matches first, none overlapping another on either side: at a search
length all unmarked windows of the item are hashed, a running Karp-Rabin hash goes over the unmarked tokens of the
document, matches are made as long as they go and marked from the longest down; then the search length falls, down to
`least`. An item is found in a document if tiles cover at least `coverage` of its tokens, in whatever order they stand.

Defined cases: null or empty texts and items without a token match nothing; items of fewer than `least` tokens match as
a whole; items with equal tokens are tiled once and each reported; rows with the same doc_id and different texts are
documents of their own and may each be reported; equal rows are reported once; a null doc_id is reported as null; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import WordHashes, parts, spare, split_join, stored, window_hashes
from siltstone.sources.tables import table

LEAST, COVERAGE = 5, 0.8
#: Bits of the seed table: a power of two, so many for each seed, and at most 16 MB; more seeds let more places through
#: to the join, which stays exact.
BITS_PER_SEED, MOST_BITS = 128, 1 << 27
#: Rows that are broadcast at most; beyond them the join shuffles.
BROADCAST_ROWS = 200_000
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PRIME, BASE = (1 << 61) - 1, 1_000_003


def token_parts(text: str | None) -> Iterator[list[bytes]]:
    """The tokens of a text, in lists of bounded size."""
    return parts((text or "").lower().encode("utf-8", "surrogatepass").translate(PLAIN))


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id and tokens (array of long) of each item that has tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            tokens = [[h for part in token_parts(x.as_py()) for h in hashes.array(part).view(np.int64).tolist()] for x in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id"), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item_id long, tokens array<long>").filter("size(tokens) > 0")


def _seeds(items: DataFrame, least: int) -> DataFrame:
    """item, seed, length (tokens of the seed) for every place of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, tokens in zip(batch.column("item").to_pylist(), batch.column("tokens").to_pylist()):
                n = min(least, len(tokens))
                out += [(item, s, n) for s in set(window_hashes(np.array(tokens, np.int64).view(np.uint64), n).view(np.int64).tolist())]
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_pydict({"item": pa.array(a, pa.int64()), "seed": pa.array(b, pa.int64()), "length": pa.array(c, pa.int32())})

    return items.mapInArrow(run, "item long, seed long, length int")


def _probes(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return seeds & mask, (seeds >> np.uint64(32)) & mask


def _set(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each bit is set."""
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def seed_table(seeds: DataFrame) -> np.ndarray:
    """A table of bits in 64-bit words in which both probes of every seed are set; at most MOST_BITS. Words are put together
    by an aggregation, so what the driver gets is the table."""
    n = seeds.count()
    bits = 1 << min(int(math.log2(MOST_BITS)), max(16, math.ceil(math.log2(max(1, n) * BITS_PER_SEED))))
    probes = F.array(F.col("seed").bitwiseAND(bits - 1), F.shiftrightunsigned("seed", 32).bitwiseAND(bits - 1))
    each = seeds.select(F.explode(probes).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
    found = each.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def _places(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """doc_id, content (hash of the text), at, seed, tokens (binary) for the places that pass the seed table."""
    size = len(bits) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text, seen, carry = text.as_py(), 0, np.empty(0, np.uint64)
                if not text:
                    continue
                content = None
                for part in token_parts(text):
                    tokens = np.concatenate((carry, hashes.array(part)))
                    for n in lengths:
                        keys = window_hashes(tokens, n)
                        a, b = _probes(keys, size)
                        hits = np.flatnonzero(_set(bits, a))
                        hits = hits[_set(bits, b[hits])]
                        if len(hits) and content is None:
                            content = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                        for i in hits.tolist():
                            out.append((doc, content, seen + i, int(keys[i].view(np.int64)), tokens[i : i + n].tobytes()))
                    kept = min(len(tokens), max(lengths) - 1)
                    seen, carry = seen + len(tokens) - kept, tokens[len(tokens) - kept :]
                if len(out) > 20_000:
                    yield rows(out)
                    out = []
            yield rows(out)

    def rows(out: list) -> pa.RecordBatch:
        a, b, c, d, e = zip(*out) if out else ((),) * 5
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(a, pa.int64()), "content": pa.array(b, pa.int64()), "at": pa.array(c, pa.int64()), "seed": pa.array(d, pa.int64()), "tokens": pa.array(e, pa.binary())})

    return docs.mapInArrow(run, "doc_id long, content long, at long, seed long, tokens binary")


def _running(tokens: list[int], marked: bytearray, length: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of every window of unmarked tokens."""
    out_of, h, run = pow(BASE, length, PRIME), 0, 0
    for i, t in enumerate(tokens):
        if marked[i]:
            h = run = 0
            continue
        h, run = (h * BASE + t) % PRIME, run + 1
        if run > length:
            h = (h - tokens[i - length] * out_of) % PRIME
        if run >= length:
            yield i - length + 1, h


def tiles(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length), none overlapping another on either side."""
    used_doc, used_item = bytearray(len(doc)), bytearray(len(item))
    found, length = [], max(least, min(len(doc), len(item)) // 2)
    while len(doc) >= least and len(item) >= least:
        starts: dict[int, list[int]] = {}
        for j, h in _running(item, used_item, length):
            starts.setdefault(h, []).append(j)
        matches, longest = [], 0
        for i, h in _running(doc, used_doc, length):
            best = (0, 0)
            for j in starts.get(h, ()):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not used_doc[i + n] and not used_item[j + n]:
                    n += 1
                best = max(best, (n, -j))
            if best[0] >= length:
                matches.append((-best[0], i, -best[1]))
                longest = max(longest, best[0])
        if longest > 2 * length:
            length = longest
            continue
        again = False
        for n, i, j in sorted(matches):
            n = -n
            if any(used_doc[i : i + n]) or any(used_item[j : j + n]):
                again = True  # what is left of it, or another match in its place, may be longer than those that follow
                break
            used_doc[i : i + n] = used_item[j : j + n] = b"\x01" * n
            found.append((i, j, n))
        if again:
            continue
        if length == least:
            break
        length = max(least, length // 2)
    return found


def _tile(least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, content, item, words, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "content", "item", "item_tokens", "places"))):
                tokens, end = [], -1
                for place in sorted(places, key=lambda p: (p["at"], len(p["tokens"]))):
                    new = np.frombuffer(place["tokens"], np.int64).tolist()
                    if place["at"] > end:
                        tokens.append(-(1 << 64) - len(tokens))  # what stands between matches nothing
                        end = place["at"]
                    tokens += new[end - place["at"] :]
                    end = max(end, place["at"] + len(new))
                covered = sum(n for _, _, n in tiles(tokens, words, min(least, len(words))))
                if covered >= coverage * len(words):
                    out.append((doc, content, item, len(words), covered))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "content", "item", "n_words", "covered"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_words (tokens of the item), covered, coverage for every item found in a document."""
    named = stored(_items(benchmark, item_id, item_text), "items")
    items = stored(named.groupBy("tokens").agg(F.min("item_id").alias("first")).select(F.xxhash64("tokens").alias("item"), "tokens"), "item-tokens")
    seeds = stored(_seeds(items, least), "seeds")
    lengths = sorted(r.length for r in seeds.select("length").distinct().collect())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not lengths:
        return rows.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("covered"), F.lit(0.0).alias("coverage"))
    few = seeds.count() <= BROADCAST_ROWS
    near = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    places, owners = _places(rows, seed_table(seeds), lengths), seeds.select("seed", "item")
    if few:
        places = places.join(F.broadcast(owners), "seed")
    else:  # a seed that very many places have stays where they are
        per_seed = owners.groupBy("seed").agg(F.collect_list("item").alias("items"))
        places = split_join(stored(places, "places"), stored(per_seed, "owners"), ["seed"]).withColumn("item", F.explode("items")).drop("items")
    gathered = places.groupBy("doc_id", "content", "item").agg(F.collect_set(F.struct("at", "tokens")).alias("places"))
    # tiles are made of seeds: too few of them cannot reach the coverage
    sized = gathered.join(near(items.withColumnRenamed("tokens", "item_tokens")), "item")
    enough = sized.filter(F.size("places") * least >= F.lit(coverage) * F.size("item_tokens"))
    found = enough.mapInArrow(_tile(least, coverage), "doc_id long, content long, item long, n_words long, covered long")
    names = stored(named.select("item_id", F.xxhash64("tokens").alias("item")).distinct(), "item-names")
    out = found.join(near(names), "item").select("doc_id", "content", "item_id", "n_words", "covered", (F.col("covered") / F.col("n_words")).alias("coverage"))
    return out.drop("content")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """`docs` without the documents in which an item is found; all columns are kept."""
    (name,) = spare(docs, "found")
    found = stored(contaminated(docs, benchmark, **how).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    key = F.col("doc_id").cast("long").eqNullSafe(F.col(name))
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, key, "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items: tiles of 5 or more words that cover 0.8 or more of an item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES: dict[str, str] = {}
