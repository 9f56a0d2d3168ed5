"""What several operators share: stored intermediate tables and word rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.scratch import new_path

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what a round of a loop wrote at a new path and no later step reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: computed once, and later stages that lose an
    executor restart from these files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a key that one task may always get in a join.
KEY_ROWS = 100_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once; how: inner or left. A key with over KEY_ROWS rows of left, and over
    a ten-thousandth of all, stays where its rows are and right's row of it is broadcast (10,000 rows at most). left is
    read several times; it should be a stored table, or a small one."""
    if left.count() <= KEY_ROWS:
        return left.join(right, keys, how)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > KEY_ROWS)
    hot = stored(counts, "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = F.broadcast(hot.filter(F.col("__n") > left.count() // 10_000).select(*keys))
    rest, few = left.join(hot, keys, "left_anti"), right.join(hot, keys, "left_semi")
    return rest.join(right, keys, how).unionByName(left.join(hot, keys, "left_semi").join(F.broadcast(few), keys, how))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be none of df's columns (in any case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of UTF-8 data (runs without ASCII white space), in lists from about `size` bytes each; none is cut."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].split()
        at = end


class WordHashes(dict):
    """64-bit XXH64 hashes of words, kept while there are few enough."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) > 1_000_000:
            self.clear()
        self[word] = found
        return found

    def array(self, words: list[bytes]) -> np.ndarray:
        """The hashes of a list of words."""
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of every n consecutive word hashes."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out *= MULTIPLIER
        out += hashes[i : i + len(out)]
    out ^= out >> np.uint64(29)
    return out * MULTIPLIER


#: Any odd number does.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def further(hashes: np.ndarray, number: int) -> np.ndarray:
    """Hashes number 0, 1, ... of what the given hashes stand for; number 0 is the hash itself."""
    if not number:
        return hashes
    x = hashes + np.uint64(number * int(MULTIPLIER) % (1 << 64))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(odd)
    return x ^ (x >> np.uint64(31))
