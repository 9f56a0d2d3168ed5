from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from siltstone.llm.fmindex import FMIndex, RangeMin
from siltstone.llm.substring import op5_repeated_passages, remove_repeats
from siltstone.sources.tables import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts, window=50):
    """Kept words by the definition, over a dictionary of all windows. texts: (doc_id, text)."""
    words, first = {d: WORDS.findall(t or "") for d, t in texts}, {}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = {}
    for d, w in words.items():
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = b"\x01" * window
        out[d] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.01"
    want = plain([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    rows = op5_repeated_passages(spark, sf).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == {d: (n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, (n, g, k) in want.items()}
    assert len(rows) == 1000 and sum(r.n_removed for r in rows) > 1000


def corpus(seed, n=120):
    rng = random.Random(seed)
    w = lambda k: [f"w{rng.randint(0, 400)}" for _ in range(k)]
    shared, out = [w(rng.randint(10, 40)) for _ in range(4)], []
    base = w(60)
    for d in range(n):
        kind = rng.randint(0, 4)
        if kind == 0:
            t = w(rng.randint(0, 60))
        elif kind == 1:
            t = base[:]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(60)] = f"edit{rng.randint(0, 3)}"
        elif kind == 2:
            t = w(rng.randint(0, 20)) + rng.choice(shared) + w(rng.randint(0, 20)) + rng.choice(shared)
        elif kind == 3:
            t = ["same"] * rng.randint(1, 60)
        else:
            t = w(5) + shared[0] + w(3) + shared[0] + w(2)
        out.append((d * 3 % 101, " \n".join(t) if rng.random() < 0.5 else "\t".join(t)))
    return list({d: (d, t) for d, t in out}.values())


@pytest.mark.parametrize("hot", [4096, 3, 1])
def test_random_corpora_with_and_without_hot_anchors(spark, hot):
    texts = corpus(hot)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = plain(texts, 10)
    got = {r.doc_id: r.text for r in remove_repeats(df, 10, hot=hot, shard_words=300).collect()}
    assert {d: WORDS.findall(t) for d, t in got.items()} == {d: k for d, (_, _, k) in want.items()}


def test_a_hot_passage_in_different_surroundings(spark):
    """One passage shorter than a window in many texts, and windows that differ in one word: several rounds of anchors."""
    rng = random.Random(8)
    w = lambda k: [f"v{rng.randint(0, 3000)}" for _ in range(k)]
    line, base = w(12), w(25)
    texts = []
    for d in range(150):
        near = base[:]
        near[rng.randrange(25)] = f"edit{rng.randint(0, 4)}"
        texts.append((d, " ".join(w(rng.randint(0, 12)) + line + w(rng.randint(5, 12)) + (near if d % 3 else base[:22]))))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = plain(texts, 15)
    for hot in (1, 20):
        got = {r.doc_id: r.text for r in remove_repeats(df, 15, hot=hot, shard_words=500).collect()}
        assert {d: WORDS.findall(t) for d, t in got.items()} == {d: k for d, (_, _, k) in want.items()}
    assert sum(g for _, g, _ in want.values()) > 500


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a, 0), (2, a, 0), (2, a, 0), (3, None, 0), (4, "", 0), (None, a, 0), (5, long, 0), (6, "pre " + long + " post", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lo int")
    got = sorted(((r.doc_id or -1, r.text) for r in remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, a), (2, ""), (2, ""), (3, None), (4, ""), (-1, a), (5, long), (6, "pre post")], key=str)
    assert remove_repeats(df.limit(0)).count() == 0


def test_matching_statistics_against_plain():
    rng = random.Random(1)
    for _ in range(40):
        texts = [np.array([rng.randint(1, rng.choice([2, 3, 5])) for _ in range(rng.randint(1, 25))]) for _ in range(rng.randint(1, 7))]
        docs = np.array([rng.randint(0, 4) for _ in texts])
        for t, d, m in zip(texts, docs, FMIndex(texts, docs, 32).matching_statistics(texts, docs)):
            for i in range(len(t)):
                best = 0
                for u, e in zip(texts, docs):
                    for j in range(len(u)) if e < d else ():
                        k = 0
                        while i + k < len(t) and j + k < len(u) and t[i + k] == u[j + k]:
                            k += 1
                        best = max(best, k)
                assert m[i] == best


def test_range_minima_against_slices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 31, 32, 33, 64, 100, 1000, 5000):
        for top in (6, 300, 100_000):
            v = rng.integers(-1, top, n)
            made = RangeMin(v)
            lo = rng.integers(0, n, 100)
            hi = np.array([rng.integers(x + 1, n + 1) for x in lo])
            assert made.least(lo, hi).tolist() == [v[a:b].min() for a, b in zip(lo, hi)]
            at, least = rng.integers(0, n + 1, 100), rng.integers(-1, max(2, top // 4), 100)
            right, left = made.reach(at, least, True), made.reach(at, least, False)
            for a, x, r, q in zip(at, least, right, left):
                assert r == next((i for i in range(a, n) if v[i] < x), n) and q == next((i for i in range(a, 0, -1) if v[i - 1] < x), 0)


def test_an_index_weighs_a_few_bytes_a_word():
    rng = np.random.default_rng(2)
    index = FMIndex([rng.integers(1, 3000, 300) for _ in range(200)], np.arange(200), 50)
    weight = sum(x.nbytes for r in (index.docs, index.common) for x in (r.values, r.flat))
    assert weight < 6 * index.n
