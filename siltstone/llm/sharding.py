"""Operator 10: rendezvous hashing of record keys over weighted shards.

Each (key, shard) pair has a score that depends on nothing else; a record goes to the shard with its highest score.
A new shard brings new scores only, so a record either stays or moves into the new shard. With weights w the score is
-w / ln(u), u uniform in (0, 1) from the MD5 digest of "key:shard", which gives shard s a share of w_s / sum(w).

Defined cases: a null key is a key of its own; repeated keys share a shard, and repeated rows get slots of their own;
empty tables give empty results; only the named columns are read and all others are carried through, but for columns that
have the names of the results, which are replaced. Texts are never read by the operator, however long they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import spare, stored
from siltstone.sources.tables import table

#: Rows that one task numbers at a time when slots are given.
ROWS_PER_BUCKET = 4096


def shard_score(key: Column, shard: Column, weight: Column | float = 1.0) -> Column:
    """The rendezvous score of a key (text) for a shard number."""
    digest = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(2**52)
    return -(weight if isinstance(weight, Column) else F.lit(float(weight))) / F.log(u)


def key_text(key: Column) -> Column:
    """The text that is hashed for a key; a null key has a text that no cast of a number gives."""
    return F.coalesce(key.cast("string"), F.lit("\u0000null"))


def assign_shards(df: DataFrame, key: str, shards: int, weights: list[float] | None = None, shard: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """`df` with the int column `shard` (0 to shards - 1) and, if `grown` is named, the shard with one more shard.

    weights: a positive weight for each shard, all 1 if not given. Nothing is shuffled.
    """
    if shards < 1 or (weights is not None and (len(weights) != shards or min(weights) <= 0)):
        raise ValueError("shards must be positive, with a positive weight each")
    text, of = key_text(F.col(key)), F.array(*[F.lit(float(w)) for w in (weights or [1.0] * shards)])
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(shard_score(text, s, F.get(of, s)).alias("score"), s.alias("shard"))))
    (temporary,) = spare(df, "best")
    out = df.withColumn(temporary, best)
    if grown:
        more = shard_score(text, F.lit(shards), grown_weight)
        out = out.withColumn(grown, F.when(more > F.col(f"{temporary}.score"), F.lit(shards)).otherwise(F.col(f"{temporary}.shard")).cast("int"))
    return out.withColumn(shard, F.col(f"{temporary}.shard").cast("int")).drop(temporary)


def give_slots(rows: DataFrame, shard: str, shards: int, slot: str = "slot") -> DataFrame:
    """`rows` (small columns only) with a gapless number from 0 within each shard, the same in every run.

    Equal rows are counted before the shuffle. Each shard is cut into buckets by the hash of whole rows, so one key may have any number of different rows; buckets are numbered
    in tasks of their own and start where the buckets before them end, so no task holds a whole shard.
    """
    columns = rows.columns
    n, bucket, held, start, first = spare(rows, "n", "bucket", "held", "start", "first")
    buckets = max(1, math.ceil(rows.count() / (shards * ROWS_PER_BUCKET)))
    equal = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias(n)).withColumn(bucket, F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    sizes = equal.groupBy(shard, bucket).agg(F.sum(n).alias(held))
    before = F.sum(held).over(Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(held)
    starts = sizes.select(shard, bucket, before.alias(start))
    inside = Window.partitionBy(shard, bucket).orderBy(*[F.col(c) for c in columns]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = equal.join(starts, [shard, bucket]).withColumn(first, F.col(start) + F.sum(n).over(inside) - F.col(n))
    return numbered.select(*columns, F.explode(F.sequence(first, F.col(first) + F.col(n) - 1)).alias(slot))


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 23 by law `key`, with each row's shard if there were 25."""
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
    )
    placed = stored(assign_shards(docs, "doc_id", 24, grown="grown_shard"), "shards")
    return give_slots(placed, "shard", 24).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _oracle() -> str:
    u = "(('0x' || substr(md5(doc_id::VARCHAR || ':' || s::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
    return f"""
WITH t AS (
  SELECT list(v ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v
    FROM range(256) r(n))),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size,
    xor(list_reduce(list_transform(range(strlen(coalesce(text, ''))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM documents, t),
p AS (
  SELECT doc_id, arg_max(s, -1 / ln({u})) FILTER (s < 24) AS shard, arg_max(s, -1 / ln({u})) AS grown_shard
  FROM documents, range(25) r(s) GROUP BY doc_id),
b AS (SELECT d.*, shard, grown_shard FROM d JOIN p USING (doc_id))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot
FROM b
"""


QUERIES = {"op10_rendezvous_sharding": op10_rendezvous_sharding}
ORACLES = {"op10_rendezvous_sharding": _oracle()}
