from __future__ import annotations

import math
import random
import struct

import pytest

from siltstone.llm.topk import exact_top_k, integer_codes, op1_exact_top_k
from siltstone.sources.tables import table
from pyspark.sql import functions as F


def plain(rows, k=10):
    """rows: (id, integer vector)."""
    out = []
    for q, a in sorted({(i, v) for i, v in rows if i % 100 == 0}):
        scored = sorted({(-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q and len(a) == len(b)})
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("vec_id", integer_codes(F.col("embedding")).alias("codes"))
    got = exact_top_k(df, df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), **how)
    return sorted(map(tuple, got.collect()))


def codes(rows):
    f = lambda x: math.floor(1024 * x)
    return [(i, tuple(map(f, v))) for i, v in rows]


def test_query_against_all_scores(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    got = op1_exact_top_k(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == plain(codes(rows))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


@pytest.mark.parametrize("lists", [1, 2, 3, 5])
def test_ties_copies_and_small_blocks(spark, lists):
    rng = random.Random(lists)
    rows = [(i, [rng.randint(-3, 3) / 4.0 for _ in range(4)]) for i in range(180)] + [(1000 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(150)]
    rows += [(300, [0.5, 0.5, -0.5, 0.25])]
    got = run(spark, [(i, v, 0) for i, v in rows], lists=lists, row_block=40, query_block=2, k=10)
    assert got == plain(codes(rows))


def test_bad_vectors_few_rows_repeats_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [3.0, nan], 1), (2, [inf, 1.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [-1.0, -2.0], 1), (100, [0.5, 0.25], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (8, [], 1)]
    good = [(i, v) for i, v, _ in rows if i in (0, 5, 100, 7)]
    assert run(spark, rows) == plain(codes(good))
    assert run(spark, [r for r in rows if r[0] == 3]) == []
    assert run(spark, [(0, [1.0], 1)]) == []


def test_large_codes_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-(2**20), 2**20)) for _ in range(3)]) for i in range(60)]
    assert run(spark, [(i, v, 0) for i, v in rows]) == plain(codes(rows))


def test_codes_beyond_32_bits(spark):
    rng = random.Random(10)
    rows = [(0, [3e6, 1.0]), (1, [1.0, 1.0]), (2, [-3e9, 2.5]), (100, [2.0**21, -7.0]), (3, [0.0, 1e8])] + [(i, [rng.uniform(-1e6, 1e6), 0.5]) for i in range(200, 230)]
    rows = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]
    assert run(spark, [(i, v, 0) for i, v in rows]) == plain(codes(rows))
    assert any(r[2] == 0 for r in plain(codes(rows)))


def test_what_no_long_holds_is_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e30, 1.0], 0), (1, [1.0, 1.0], 0)])
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e9, 1.0], 0), (1, [1e9, 1.0], 0)])


def test_the_cutoff_saves_scores(spark):
    """On skewed vectors few rows are resolved, and the lists' depth does not change the result."""
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) * (8 if i % 50 == 1 else 1) for _ in range(16)], 0) for i in range(3000)]
    rows = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in v], l) for i, v, l in rows]
    want, n_queries = plain(codes([r[:2] for r in rows])), 30
    for depth in (4, 64):
        counted = spark.sparkContext.accumulator(0)
        assert run(spark, rows, row_block=500, query_block=16, depth=depth, counted=counted) == want
        assert counted.value < 0.05 * n_queries * len(rows)
