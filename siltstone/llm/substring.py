"""Operator 5: removal of repeated passages, found by matching statistics on FM-indexes of shards.

A window of `window` words has an anchor: of the runs of GRAM words in it, the leftmost with the least hash. Equal
windows have equal anchors in equal places, so what has to be compared are the segments of text around equal anchors:
an anchor and all windows of a document that share it. Segments whose anchor is in one document only cannot repeat.
Of the others, equal segments are one, kept with the smallest doc_id that holds it, and every larger doc_id loses all
words of it. What is left are different segments around equal anchors; they are dealt to shards by anchor, a shard's
segments are indexed by their words (siltstone.llm.fmindex), and each is streamed through the index of its shard, which
gives the length of the longest match with a smaller doc_id at every place: where that is a window or more, the
window's words go.

Anchors that more than `hot` different segments share are not given to one task: their segments are cut again around
anchors of their own, found by another hash, and go the same way once more, through shards and indexes; after LEVELS such
rounds the anchor is the whole window. So equal passages of any number make indexes of bounded size.

Words are compared as words inside a shard, and by 128 bits of hashes where equal segments are put together: an exact
repeat of a whole segment is found there, before any index, and the indexes find what different segments share.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; a null doc_id neither
loses words nor takes any from others; rows that repeat a doc_id are one document in comparisons and are each returned;
empty tables give empty results; other columns are carried by `remove_repeats` and not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.fmindex import FMIndex
from siltstone.llm.shared import MULTIPLIER, WordHashes, further, parts, spare, split_join, stored, window_hashes
from siltstone.sources.tables import table

GRAM = 8
#: Words of a shard's index, about; different segments of an anchor beyond which it is hot.
SHARD_WORDS, HOT = 150_000, 4096
#: Words of a document whose anchors are found at a time.
SPAN = 1 << 16
#: Rounds of anchors that are runs of GRAM words.
LEVELS = 3
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def range_hashes(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words of each range [lo, hi)."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(len(hashes), MULTIPLIER), dtype=np.uint64)))
    out = (sums[hi] - sums[lo]) * _powers(len(hashes) + 1, INVERSE)[lo]
    out ^= (hi - lo).astype(np.uint64) * MULTIPLIER
    out ^= out >> np.uint64(31)
    return out * MULTIPLIER


def segments(hashes: np.ndarray, window: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, segment hash, first word, number of words) of the segments of a text's word hashes."""
    keys, hashed, firsts, sizes = [], [], [], []
    gram = min(GRAM, window) if level < LEVELS else window
    inner = window - gram + 1
    for at in range(0, max(0, len(hashes) - window + 1), SPAN):
        part = hashes[at : at + SPAN + window - 1]
        grams = further(window_hashes(part, gram), level)
        starts = np.arange(len(part) - window + 1)
        anchor = starts + np.lib.stride_tricks.sliding_window_view(grams, inner).argmin(axis=1)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.concatenate((first[1:], [len(starts)])) - 1
        keys.append(grams[anchor[first]])
        hashed.append(range_hashes(part, first, last + window))
        firsts.append(first + at)
        sizes.append(last + window - first)
    if not keys:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    return tuple(np.concatenate(x) for x in (keys, hashed, firsts, sizes))


def _hashes_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    found = [hashes.array(p) for p in parts((text or "").encode("utf-8", "surrogatepass"))]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _find_segments(window: int, level: int):
    """The segments of texts (doc_id, parent, part, text); a key is the anchor's hash and that of the parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            held, size = [], 0
            for doc, parent, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "parent", "part")), batch.column("text")):
                if doc is None:
                    continue
                key, seg, first, words = segments(_hashes_of(text.as_py(), hashes), window, level)
                if len(key):
                    key = further(key ^ np.uint64(parent % (1 << 64)), 1) if level else key
                    held.append((np.full(len(key), doc), np.full(len(key), part), key.view(np.int64), seg.view(np.int64), first, words))
                    size += len(key)
                if size > 50_000:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    def rows(held: list) -> pa.RecordBatch:
        a, b, c, d, e, f = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(a, pa.int64()), "part": pa.array(b, pa.int64()), "key": pa.array(c), "seg": pa.array(d), "first": pa.array(e, pa.int32()), "size": pa.array(f, pa.int32())})

    return run


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts (key, seg, doc_id, hot, text) of the wanted segments of texts."""

    def rows(out: list) -> pa.RecordBatch:
        a, b, c, d, e = zip(*out) if out else ((),) * 5
        return pa.RecordBatch.from_pydict({"key": pa.array(a, pa.int64()), "seg": pa.array(b, pa.int64()), "doc_id": pa.array(c, pa.int64()), "hot": pa.array(d, pa.bool_()), "text": pa.array(e, pa.string())})

    hashes = WordHashes()
    for batch in batches:
        out, held = [], 0
        for doc, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
            words = [w for p in parts((text.as_py() or "").encode("utf-8", "surrogatepass")) for w in p]
            wanted = [w for w in wanted if w["first"] + w["size"] <= len(words)]
            if not wanted:
                continue
            lo = np.array([w["first"] for w in wanted])
            found = range_hashes(hashes.array(words), lo, lo + np.array([w["size"] for w in wanted])).view(np.int64)
            for w, seg in zip(wanted, found.tolist()):
                if seg == w["seg"]:  # else it is another row with this doc_id
                    out.append((w["key"], seg, doc, w["hot"], b" ".join(words[w["first"] : w["first"] + w["size"]]).decode("utf-8", "surrogatepass")))
                    held += len(out[-1][4])
            if held > 1 << 23:
                yield rows(out)
                out, held = [], 0
        yield rows(out)


def _search_shard(window: int):
    """For a shard's segments (key, seg, doc_id, text): (key, seg, lo, hi), the words that go, from the segment's start."""

    def run(key, shard):
        rows = sorted({(k, s, d): t for k, s, d, t in zip(*(shard.column(c).to_pylist() for c in ("key", "seg", "doc_id", "text")))}.items())
        numbers: dict[bytes, int] = {}
        texts = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in t.split(" ")], np.int64) for _, t in rows]
        docs = np.unique([d for (_, _, d), _ in rows], return_inverse=True)[1]
        out = []
        if len(texts) > 1:
            index = FMIndex(texts, docs, 2 * window)
            for (k, s, _), found in zip((r[0] for r in rows), index.matching_statistics(texts, docs)):
                at = np.flatnonzero(found >= window)
                if len(at):
                    for run_of in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                        out.append((k, s, int(run_of[0]), int(run_of[-1]) + window))
        a, b, c, d = zip(*out) if out else ((),) * 4
        return pa.table({"key": pa.array(a, pa.int64()), "seg": pa.array(b, pa.int64()), "lo": pa.array(c, pa.int32()), "hi": pa.array(d, pa.int32())})

    return run


def repeated_ranges(docs: DataFrame, window: int = 50, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, lo, hi): word ranges of documents, maybe overlapping, whose union is what windows that also start in a
    document with a smaller doc_id cover. docs: (doc_id, text)."""
    none = F.lit(0).cast("long")
    return _ranges(docs.select("doc_id", none.alias("parent"), none.alias("part"), "text"), window, hot, shard_words, 0).drop("part")


def _ranges(texts: DataFrame, window: int, hot: int, shard_words: int, level: int) -> DataFrame:
    """(doc_id, part, lo, hi) of texts (doc_id, parent, part, text): part names a text of a document, and only texts of one
    parent are compared."""
    found = stored(texts.mapInArrow(_find_segments(window, level), "doc_id long, part long, key long, seg long, first int, size int"), "segments")
    shared = found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("key")
    shared = stored(shared, "segments-keys")  # so that the join deals out both sides and can split a hot key
    repeated = stored(found.join(shared, "key", "left_semi"), "segments-shared")
    least = stored(repeated.groupBy("key", "seg").agg(F.min(F.struct("doc_id", "part", "first", "size")).alias("x")).select("key", "seg", "x.*"), "segments-least")

    several = least.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", ((F.col("n") > hot) & F.lit(level < LEVELS)).alias("hot"))
    wanted = least.join(stored(several, "segments-several"), "key").groupBy("doc_id", "part").agg(F.collect_list(F.struct("key", "seg", "first", "size", "hot")).alias("wanted"))
    cut = stored(texts.join(wanted, ["doc_id", "part"]).select("doc_id", "text", "wanted").mapInArrow(_cut_segments, "key long, seg long, doc_id long, hot boolean, text string"), "segments-cut")

    some = cut.filter("NOT hot")
    size = some.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shard = F.pmod(F.col("key"), F.lit(max(1, math.ceil(size / (6 * shard_words))))).alias("shard")
    searched = some.select(shard, "key", "seg", "doc_id", "text").groupBy("shard").applyInArrow(_search_shard(window), "key long, seg long, lo int, hi int")
    searched = stored(searched, "segments-found")
    again = cut.filter("hot").dropDuplicates(["key", "seg"]).withColumn("part", F.xxhash64("key", "seg"))
    if not again.isEmpty():
        deeper = _ranges(again.select("doc_id", F.col("key").alias("parent"), "part", "text"), window, hot, shard_words, level + 1)
        searched = searched.unionByName(deeper.join(again.select("doc_id", "part", "key", "seg"), ["doc_id", "part"]).select("key", "seg", "lo", "hi"))

    held = split_join(repeated, least.select("key", "seg", F.col("doc_id").alias("least")), ["key", "seg"])
    whole = held.filter("doc_id > least").select("doc_id", "part", F.col("first").alias("lo"), (F.col("first") + F.col("size")).alias("hi"))
    own = held.filter("doc_id = least").join(searched, ["key", "seg"]).select("doc_id", "part", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))
    return whole.unionByName(own)


def _merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kept_words(text: str | None, ranges: list[tuple[int, int]]) -> Iterator[list[bytes]]:
    """The words of a text outside the merged ranges, in lists."""
    at, todo = 0, list(reversed(ranges))
    for part in parts((text or "").encode("utf-8", "surrogatepass")):
        end, start = at + len(part), at
        while todo and todo[-1][0] < end:
            lo, hi = todo[-1]
            yield part[start - at : max(lo, start) - at]
            start = min(max(hi, start), end)
            if hi > end:
                break
            todo.pop()
        yield part[start - at :]
        at = end


def _with_ranges(docs: DataFrame, ranges: DataFrame, out: str) -> DataFrame:
    (doc,) = spare(docs, "of_doc")
    per_doc = ranges.distinct().groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("lo", "hi")).alias(out))
    return docs.join(per_doc, F.col("doc_id").cast("long") == F.col(doc), "left").drop(doc)


def remove_repeats(docs: DataFrame, window: int = 50, text: str = "text", **how) -> DataFrame:
    """`docs` with the kept words of each text, joined by one space; rows and other columns are kept. Key: doc_id."""
    (gone,) = spare(docs, "ranges")
    ranged = _with_ranges(docs, repeated_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), window, **how), gone)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [x.as_py() if not r or x.as_py() is None else b" ".join(w for p in kept_words(x.as_py(), _merged(r)) for w in p).decode("utf-8", "surrogatepass") for x, r in zip(batch.column(text), batch.column(gone).to_pylist())]
            yield pa.RecordBatch.from_pydict({c: pa.array(new, pa.string()) if c == text else batch.column(c) for c in columns})

    return ranged.mapInArrow(run, docs.schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, shas = [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
            text, merged, sha, kept = text.as_py(), _merged(ranges), hashlib.sha256(), 0
            for words in kept_words(text, merged):
                if words:
                    sha.update((b" " if kept else b"") + b" ".join(words))
                    kept += len(words)
            removed = sum(hi - lo for lo, hi in merged)
            total.append(kept + removed)
            gone.append(removed)
            shas.append(sha.hexdigest())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those that repeated windows of 50 cover, and a digest of the words that are kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _with_ranges(docs, repeated_ranges(docs), "ranges").select("doc_id", "text", "ranges").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


QUERIES = {"op5_repeated_passages": op5_repeated_passages}
ORACLES: dict[str, str] = {}
