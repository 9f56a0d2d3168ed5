from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from siltstone.llm import periodic
from siltstone.llm.periodic import best_run, collapse, find_runs, op13_periodic_runs, periodic_runs, smaller_period, surviving
from siltstone.sources.tables import table


def brute(w):
    """All runs, lag by lag and word by word."""
    found = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if j > i and len(x) >= max(24, 3 * q) and not any(x[d:] == x[:-d] for d in range(1, q)):
                found.append((i, len(x), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(seed, n):
    rnd = random.Random(seed)
    w = []
    while len(w) < n:
        kind = rnd.random()
        if kind < 0.3:
            w += [rnd.choice("abc") for _ in range(rnd.randint(1, 60))]
        elif kind < 0.8:
            block = [rnd.choice("abcdefgh"[: rnd.randint(1, 8)]) for _ in range(rnd.choice([1, 2, 3, 5, 9, 30, 70, 100, 140]))]
            w += (block * rnd.randint(2, 6))[: rnd.randint(1, 500)]
        else:
            w += [str(rnd.random()) for _ in range(rnd.randint(1, 10))]
    return [x.encode() for x in w]


@pytest.mark.parametrize("direct", [8, 64])
def test_runs_against_brute_force(monkeypatch, direct):
    monkeypatch.setattr(periodic, "DIRECT", direct)
    texts = [made(i, n) for i, n in enumerate([10, 60, 300, 900] * 20)]
    texts += [[], [b"a"] * 23, [b"a"] * 24, [b"a"] * 700, [b"a", b"b"] * 200 + [b"c"] + [b"a", b"b"] * 200]
    assert find_runs(texts) == [brute(w) for w in texts]


def test_splitting_recurses_until_nothing_is_rare():
    import numpy as np

    # 9 occurs often enough at first, and no longer once 5 has split the segment
    ids = np.array([1, 2] * 15 + [9, 9] + [5] + [9] + [3, 4] * 15)
    lo, hi = surviving(ids, np.array([0]), np.array([len(ids)]))
    assert sorted(zip(lo.tolist(), hi.tolist())) == [(0, 30), (34, 64)]


def test_smallest_period():
    import numpy as np

    assert smaller_period(np.array([1, 2] * 18), 12) and smaller_period(np.array([1] * 24), 7)
    assert not smaller_period(np.array([1, 2, 3] * 9), 3)


def test_a_long_text_of_one_word():
    assert find_runs([[b"x"] * 1_000_000]) == [[(0, 1_000_000, 1)]]


def test_query_against_brute_force(spark, sf_dir):
    rows = {r.doc_id: r for r in op13_periodic_runs(spark, sf_dir).collect()}
    planted = 0
    for d in table(spark, sf_dir, "documents").collect():
        w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", d.text or "")]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 500:
            continue
        runs, r = brute(w), rows[d.doc_id]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(w, runs)).hexdigest()
    assert planted > 5 and sum(r.n_runs for r in rows.values()) > 5


def test_nulls_empty_and_clashing_columns(spark):
    one = " ".join(["a b c"] * 9)
    df = spark.createDataFrame([(1, None, "x", 5), (2, "", "y", 5), (3, " \t  ", "z", 5), (4, one, "u", 5), (4, one, "u", 5)], "doc_id long, text string, runs string, data long")
    out = sorted(periodic_runs(df).collect(), key=lambda r: r.doc_id)
    assert out[0].asDict().keys() == {"doc_id", "text", "data", "runs", "collapsed"} and out[0].text is None
    assert [(r.collapsed, len(r.runs)) for r in out] == [("", 0), ("", 0), (" ", 0), ("a b c", 1), ("a b c", 1)]
    assert tuple(out[3].runs[0]) == (0, 27, 3) and {r.data for r in out} == {5}
    assert periodic_runs(df.limit(0)).count() == 0
    same = periodic_runs(df.select("doc_id", "text"), collapsed="text").orderBy("doc_id").collect()
    assert same[3].text == "a b c"


def test_null_ids_keep_their_texts(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.text or "") for r in periodic.with_repeats(df).collect()) == ["", "a b"]


def test_best_run_is_exact(spark):
    big = 10**9
    df = spark.createDataFrame([([(5, 3 * big + 1, big), (0, 3 * big, big), (0, 3 * big + 1, big)],)], "runs array<struct<start:long,length:long,period:long>>")
    assert tuple(df.select(best_run(df["runs"]).alias("b")).first().b) == (5, 3 * big + 1, big)
