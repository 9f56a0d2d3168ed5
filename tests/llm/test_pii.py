from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from siltstone.llm import pii
from siltstone.llm.pii import KINDS, LABELS, Shapes, all_spans, base_spans, cut, examples, find_private, fit, labelled_table, luhn, op12_private_data, passes, sums, train, viterbi
from siltstone.sources.tables import table


def plain(text):
    """The base patterns by plain regular expressions."""
    found = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if fits[kind]:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


@pytest.fixture(scope="module")
def field():
    return train(examples())


def test_base_patterns_against_regular_expressions():
    rnd = random.Random(3)
    pieces = ["a", "b.c", "@", ".", "-", "+", " ", "(", ")", "é", "1", "25", "256", "000", "4539578763621486", "0049", "12.13.14.15", "x@y.z", "+1 (743) 555-3824", "\n", "%", "_", "9" * 30, "٣"]
    for _ in range(4000):
        text = "".join(rnd.choices(pieces, k=rnd.randint(1, 14)))
        assert base_spans(text) == plain(text), text


def test_base_patterns_take_time_in_proportion():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "+" + "(" * 300_000):
        assert len(base_spans(text)) <= 50_000


def brute_paths(scores, moves):
    for path in itertools.product(range(len(LABELS)), repeat=len(scores)):
        if pii.FIRST[path[0]] and all(pii.ALLOWED[a, b] for a, b in itertools.pairwise(path)):
            yield sum(scores[t, b] for t, b in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)), path


def test_viterbi_and_sums_against_all_paths():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(0, 2, (6, 4, len(LABELS))), rng.normal(0, 2, (len(LABELS), len(LABELS)))
    logs, marginals, expected = sums(scores, moves)
    total = np.zeros_like(expected)
    for i, found in enumerate(viterbi(scores, moves)):
        paths = list(brute_paths(scores[i], moves))
        assert tuple(found) == max(paths)[1]
        z = np.logaddexp.reduce([s for s, _ in paths])
        assert abs(z - logs[i]) < 1e-9
        for s, path in paths:
            for t, b in enumerate(path):
                marginals[i, t, b] -= np.exp(s - z)
            for a, b in itertools.pairwise(path):
                total[a, b] += np.exp(s - z)
    assert np.abs(marginals).max() < 1e-9 and np.abs(total - expected).max() < 1e-9


def test_held_out_examples(field):
    right = wrong = missed = 0
    test = examples(900, seed=99)
    for (text, spans), found in zip(test, all_spans([t for t, _ in test], field, Shapes())):
        told, wanted = {(x["start"], x["end"], x["kind"]) for x in found}, set(spans)
        right, wrong, missed = right + len(told & wanted), wrong + len(told - wanted), missed + len(wanted - told)
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.94


def test_exact_checks():
    assert passes("email", "a at b dot com") and passes("email", "a(at)b.com") and not passes("email", "meet at noon. Then") and not passes("email", "a at b.com")
    assert passes("ip", "1[.]2[.]3[.]255") and not passes("ip", "1[.]2[.]3[.]256") and not passes("ip", "1.2.3.4")
    assert passes("card", "4539.5787.6362.1486") and not passes("card", "4539.5787.6362.1487")
    assert passes("phone", "(030) 1234 5678") and not passes("phone", "978-3-16-148410-0")


def test_base_spans_stay_and_added_ones_leave_them_room(field):
    text = "write joe at host dot org or joe@host.org, (030) 1234 5678 and +49 30 1234 5678 " * 40
    (found,) = all_spans([text], field, Shapes())
    assert [(x["start"], x["end"], x["kind"]) for x in found if x["base"]] == plain(text)
    for x in found:
        if not x["base"]:
            assert passes(x["kind"], text[x["start"] : x["end"]]) and not any(y["base"] and y["start"] < x["end"] and x["start"] < y["end"] for y in found)
    assert sum(not x["base"] for x in found) >= 60


def test_windows_label_each_word_once():
    text = "7 " * 1000
    words, windows = cut(text)
    assert len(words) == 1000 and [i for _, _, a, b in windows for i in range(a, b)] == list(range(1000)) and all(b - a <= pii.WINDOW for a, b, _, _ in windows)
    words, windows = cut("a " * 20 + "5 " + "b " * 30 + "@c " + "d " * 3)
    assert [(a, b) for a, b, _, _ in windows] == [(14, 27), (45, 55)]
    assert cut("nothing here") == ([], [])


def test_query_on_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = op12_private_data(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[2] == k for x in base) for k in KINDS]
        told = [f"{k}:{s}:{e}" for s, e, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r.spans.split(",")) or not told
        assert not r.n_added or len(r.spans.split(",")) == len(base) + r.n_added


def test_nulls_empty_long_and_clashing_columns(spark):
    model = fit(labelled_table(spark, 120))
    long = "wort " * 100_000 + "a@b.cd " + "wort " * 100_000
    rows = [(1, None, 3), (2, "", 3), (3, long, 3), (4, "née 日本 \U0001f600 x@y.zz", 3), (4, "née 日本 \U0001f600 x@y.zz", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = find_private(df, model).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in out] == [[], [], [("email", 500_000, 500_006)], [("email", 9, 15)], [("email", 9, 15)]]
    assert [r.text for r in out] == [r[1] for r in rows] and find_private(df.limit(0), model).count() == 0
    kept = find_private(df.withColumnRenamed("spans", "start").withColumn("base", df.doc_id), model)
    assert kept.columns == ["doc_id", "text", "start", "base", "spans"] and kept.filter("base = doc_id AND start = 3").count() == 5


def test_the_same_table_gives_the_same_field(spark):
    one, two = (fit(labelled_table(spark, 60).repartition(n)) for n in (1, 3))
    assert np.array_equal(one.weights, two.weights) and one.numbers == two.numbers
    assert fit(labelled_table(spark, 60).limit(0)).numbers == {}
