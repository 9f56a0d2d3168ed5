"""Operator 1: exact top-k by inner product with a three-phase uniform threshold.

The components of a vector are cut into `lists` runs; a run's partial inner product with a query is a local score, and
for each query the rows ordered by a local score are one list. A row's score is the sum of its local scores. Rows stay
where they are, in blocks of about ROW_BLOCK rows that are one Parquet row each; queries come round by round in
broadcasts of about QUERY_BLOCK, each read from a folder of its own.

Phase 1 (gather): every block keeps, for each query and list, its DEPTH highest local scores in order, with the floor
below which it has kept none. The rows at the head of a block's lists (k of each) are scored in full; the k-th highest
of these scores over all blocks bounds the k-th best score of the query from below.
Phase 2 (broadcast the cutoff): the bound over the number of lists, rounded up, is the query's cutoff; a row whose local
scores are all below it has a score below the bound. The cutoffs and bounds of a round's queries are broadcast.
Phase 3 (collect and resolve): every block reads the entries at or above the cutoff from its lists. Only where a list's
floor is not below the cutoff does it go through its rows once more for that list. A row whose known local scores and,
for its unknown ones, just less than the cutoff cannot reach the bound is out; the missing local scores of the others
are resolved exactly, and each block returns its k best rows.

Defined cases: vectors that are null, empty, hold null or non-finite components take no part; a code that passes 64 bits,
or a returned score that does, is an error that names its vector, as no long could hold it; vectors of different lengths
are not compared; a repeated (id, vector) row counts once, and if an id has several vectors its query is the least of
them; a null id takes no part; equal vectors are one row that keeps its k + 1 smallest ids; fewer than k candidates give
all; ties go to smaller ids; an empty table gives an empty result; other columns are not read. Scores are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import removed, stored
from siltstone.sources.scratch import new_path
from siltstone.sources.tables import table

#: Rows of a block and queries of a round, about, and entries that a block keeps of a list. A round writes the rows once more
#: beside their lists, which are three times as large for so many queries, so rounds should not be small.
ROW_BLOCK, QUERY_BLOCK, DEPTH = 4096, 4096, 64
#: Files of blocks at most.
MOST_FILES = 20_000
#: Queries whose products with a block are held at a time.
TOGETHER = 64


def integer_codes(vector: Column, name: Column | None = None, scale: float = 1024.0) -> Column:
    """floor(scale * x) for every component as longs; null where the vector takes no part. name: what an error about a code
    that no long holds calls the vector."""
    told = F.concat(F.lit("a code passes 64 bits in vector "), F.coalesce(name.cast("string"), F.lit("null")) if name is not None else F.lit("?"))

    def code(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when((y < -(2.0**63)) | (y >= 2.0**63), F.raise_error(told).cast("long")).otherwise(F.floor(y))

    good = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, code))


def _parts(dim: int, lists: int) -> list[tuple[int, int]]:
    cuts = [dim * i // lists for i in range(lists + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exactly: in doubles where no sum can pass 2**53, in 64-bit integers where none
    can pass 2**58 (so that a few of them add up in 64 bits), else in Python's integers."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    kind = np.int64 if most < 2**58 else object
    return queries.astype(kind) @ rows.astype(kind).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, ties to smaller ids."""
    if len(scores) > k and scores.dtype != object:
        found = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((ids[found], -scores[found]))][:k]


#: No second id. Ids may be any long but this one.
NO_ID = -(2**63)


class Block:
    """The rows of one block: codes, all ids, and the smallest and second smallest id of each."""

    def __init__(self, ids: list[list[int]], codes: np.ndarray, lists: int):
        self.ids, self.codes, self.parts = ids, codes, _parts(codes.shape[1], lists)
        self.first = np.array([x[0] for x in ids], np.int64)
        self.second = np.array([x[1] if len(x) > 1 else NO_ID for x in ids], np.int64)

    def local(self, queries: np.ndarray, i: int) -> np.ndarray:
        a, b = self.parts[i]
        return products(queries[:, a:b], self.codes[:, a:b])

    def other(self, me: int) -> np.ndarray:
        """The rows that have another id than the query's."""
        return (self.first != me) | (self.second != NO_ID)

    def heads(self, local: np.ndarray, depth: int) -> np.ndarray:
        """Per query the rows of the highest local scores, in order."""
        n = local.shape[1]
        if n > depth and local.dtype != object:
            at = np.argpartition(local, n - depth, axis=1)[:, n - depth :]
        else:
            at = np.broadcast_to(np.arange(n), local.shape)
        order = np.argsort(-np.take_along_axis(local, at, axis=1), axis=1, kind="stable")[:, :depth]
        return np.take_along_axis(at, order, axis=1)


def _queries(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension the ids and codes of the queries of a round."""
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r.codes), []).append(r)
    return {d: (np.array([r.query_id for r in x], np.int64), np.array([r.codes for r in x], np.int64)) for d, x in out.items()}


def _blocks(batches: Iterator[pa.RecordBatch], lists: int) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].as_py()
            yield batch, i, Block(ids, batch.column("codes")[i].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1), lists)


def _gather(queries, lists: int, k: int, depth: int):
    """Phase 1, for a round of queries: each block as it is, with its lists (rows and local scores, per list and query), and
    the k best full scores that the heads of its lists give for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        for batch, i, block in _blocks(batches, lists):
            qid, codes = asked.get(block.codes.shape[1], (np.empty(0, np.int64), np.empty((0, block.codes.shape[1]), np.int64)))
            places, scores, bound_of, bounds = [], [], [], []
            for at in range(0, len(qid), TOGETHER):
                q = codes[at : at + TOGETHER]
                heads = [(h := block.heads(x, max(depth, k + 1)), np.take_along_axis(x, h, axis=1)) for x in (block.local(q, j) for j in range(len(block.parts)))]
                places.append(np.stack([h for h, _ in heads], axis=1))
                scores.append(np.stack([x for _, x in heads], axis=1))
                for j, me in enumerate(qid[at : at + TOGETHER].tolist()):
                    some = np.unique(np.concatenate([h[j, : k + 1] for h, _ in heads]))
                    some = some[block.other(me)[some]]
                    full = products(q[j : j + 1], block.codes[some])[0]
                    for x in sorted(full.tolist(), reverse=True)[:k]:
                        bound_of.append(me)
                        bounds.append(min(max(x, -(2**63)), 2**63 - 1))
            flat = lambda x: np.concatenate(x).reshape(-1) if x else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "ids": batch.column("ids").slice(i, 1), "codes": batch.column("codes").slice(i, 1),
                "places": pa.array([flat(places).astype(np.int32).tolist()], pa.list_(pa.int32())),
                "scores": pa.array([[str(x) for x in flat(scores).tolist()] if flat(scores).dtype == object else None], pa.list_(pa.string())),
                "locals": pa.array([None if flat(scores).dtype == object else flat(scores)], pa.list_(pa.int64())),
                "bound_of": pa.array([bound_of], pa.list_(pa.int64())), "bounds": pa.array([bounds], pa.list_(pa.int64())),
            })

    return run, "ids array<array<long>>, codes array<long>, places array<int>, scores array<string>, locals array<long>, bound_of array<long>, bounds array<long>"


def _resolve(queries, told, lists: int, k: int, counted=None):
    """Phases 2 and 3, for a round of queries whose bounds are told: the k best of each block. counted: an accumulator of the
    scores that were resolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, bounds = queries.value, told.value
        for batch, i, block in _blocks(batches, lists):
            if block.codes.shape[1] not in asked:
                continue
            qid, codes = asked[block.codes.shape[1]]
            m, n = len(block.parts), len(block.first)
            known_scores = batch.column("locals")[i]
            known_scores = known_scores.values.to_numpy() if known_scores.is_valid else np.array([int(x) for x in batch.column("scores")[i].as_py()], object)
            places = batch.column("places")[i].values.to_numpy().reshape(len(qid), m, -1)
            known_scores = known_scores.reshape(places.shape)
            out_q, out_id, out_score = [], [], []
            for j, me in enumerate(qid.tolist()):
                bound = bounds.get(me)
                if bound is None:  # fewer than k rows have been scored: all take part
                    seen = np.arange(n)
                    if counted is not None:
                        counted.add(n)
                    seen = seen[block.other(me)]
                    total = products(codes[j : j + 1], block.codes[seen])[0]
                else:
                    cutoff = -(-bound // m)
                    have = np.zeros((m, n), bool)
                    local = np.zeros((m, n), known_scores.dtype)
                    for x in range(m):
                        entries = known_scores[j, x] >= cutoff
                        if entries.all() and places.shape[2] < n:  # the list goes on below its floor
                            local[x] = block.local(codes[j : j + 1], x)[0]
                            have[x] = local[x] >= cutoff
                        else:
                            have[x, places[j, x][entries]] = True
                            local[x, places[j, x][entries]] = known_scores[j, x][entries]
                    seen = np.flatnonzero(have.any(axis=0) & block.other(me))
                    most = np.where(have[:, seen], local[:, seen], max(cutoff - 1, -(2**63))).sum(axis=0)
                    seen = seen[most >= bound]
                    for x in range(m):
                        lacking = seen[~have[x, seen]]
                        if len(lacking):
                            a, b = block.parts[x]
                            local[x, lacking] = products(codes[j : j + 1, a:b], block.codes[lacking, a:b])[0]
                    total = local[:, seen].sum(axis=0)
                    if counted is not None:
                        counted.add(len(seen))
                least = np.where(block.first[seen] == me, block.second[seen], block.first[seen])
                found = []
                for x in _best(total, least, k).tolist() if len(seen) else []:
                    found += [(-int(total[x]), r) for r in block.ids[int(seen[x])] if r != me]
                for score, r in sorted(found)[:k]:
                    if not -(2**63) <= -score < 2**63:
                        raise OverflowError(f"the score of query {me} and vector {r} passes 64 bits")
                    out_q.append(me)
                    out_id.append(r)
                    out_score.append(-score)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_score, pa.int64())})

    return run, "query_id long, vec_id long, score long"


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 2, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, depth: int = DEPTH, counted=None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of vectors (vec_id, codes) with the highest inner product for
    each of queries (query_id, codes), ties to smaller ids, without the row whose id is the query's. counted: an
    accumulator that takes the number of scores resolved in phase 3."""
    spark = vectors.sparkSession
    each = stored(queries.filter("query_id IS NOT NULL AND codes IS NOT NULL").groupBy("query_id").agg(F.min("codes").alias("codes")), "topk-queries")
    # a hash deals queries to rounds, with room for chance; each round is broadcast by itself
    n_queries = each.count()
    n_rounds = max(1, math.ceil(n_queries / (0.8 * query_block))) if n_queries > query_block else 1
    rounds_path = new_path(spark, "topk-rounds")
    each.withColumn("round", F.pmod(F.xxhash64("query_id"), F.lit(n_rounds))).repartition("round").write.partitionBy("round").parquet(rounds_path)
    rounds = spark.read.schema("query_id long, codes array<long>, round long").parquet(rounds_path)
    # equal vectors: of each, the k + 1 smallest ids; the rank limit is applied before the shuffle as well
    rank = F.row_number().over(Window.partitionBy("codes").orderBy("vec_id"))
    ids = vectors.filter("vec_id IS NOT NULL AND codes IS NOT NULL").dropDuplicates(["vec_id", "codes"]).withColumn("r", rank).filter(F.col("r") <= k + 1)
    items = stored(ids.groupBy("codes").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "topk-rows")
    n_blocks = max(1, math.ceil(items.count() / row_block))
    block = F.pmod(F.xxhash64(F.element_at("ids", 1), F.lit("block")), F.lit(n_blocks))
    # as many files as blocks, up to a bound, so that rounds are dealt out to all tasks
    placed = items.withColumn("b", block).repartition(min(n_blocks, MOST_FILES), "b")
    dealt = placed.groupBy("b", F.size("codes").alias("dim")).agg(F.collect_list(F.struct("ids", "codes")).alias("x"))
    blocks = stored(dealt.select(F.col("x.ids").alias("ids"), F.flatten("x.codes").alias("codes")), "topk-blocks")

    path = new_path(spark, "topk-best")
    for number in range(n_rounds):
        asked = spark.sparkContext.broadcast(_queries(rounds.filter(F.col("round") == number).collect()))
        run, schema = _gather(asked, lists, k, depth)
        lists_path = new_path(spark, "topk-lists")
        blocks.mapInArrow(run, schema).write.parquet(lists_path)
        gathered = spark.read.schema(schema).parquet(lists_path)
        heads = gathered.select(F.explode(F.arrays_zip("bound_of", "bounds")).alias("x")).select("x.bound_of", F.col("x.bounds").alias("score"))
        ranked = heads.withColumn("r", F.row_number().over(Window.partitionBy("bound_of").orderBy(F.desc("score")))).filter(F.col("r") <= k)
        bounds = ranked.groupBy("bound_of").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bound")).filter(F.col("n") == k)
        told = spark.sparkContext.broadcast({r.bound_of: int(r.bound) for r in bounds.collect()})
        run, schema = _resolve(asked, told, lists, k, counted)
        gathered.drop("bound_of", "bounds").mapInArrow(run, schema).write.mode("append").parquet(path)
        removed(spark, lists_path)
        asked.destroy()
        told.destroy()
    final = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return final.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all other embeddings for every one whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", integer_codes(F.col("embedding"), F.col("vec_id")).alias("codes"))
    return exact_top_k(rows, rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))


QUERIES = {"op1_exact_top_k": op1_exact_top_k}
ORACLES = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
}
