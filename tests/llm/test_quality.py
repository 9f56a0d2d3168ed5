from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np

from siltstone.llm import quality
from siltstone.llm.quality import ORDER, SYMBOLS, count_grams, judge, model_tables, op6_quality
from siltstone.sources.tables import table

ROWS = "doc_id long, text string, lang string"


def plain_grams(text):
    s = [32] * (ORDER - 1)
    for x in text.encode():
        x = 32 if x in b" \t\n\v\f\r" else x
        if x != 32 or s[-1] != 32 or len(s) == ORDER - 1:
            s.append(x)
    return [tuple(s[i : i + ORDER]) for i in range(len(s) - ORDER + 1)]


def plain_model(texts):
    """Interpolated modified Kneser-Ney by its definition, over dictionaries."""
    counts = {ORDER: Counter(g for t in texts for g in plain_grams(t))}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = {}
    for n, c in counts.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        d = [0.0] + [min(max(i - (i + 1) * y * m[i + 1] / m[i], 0), i) if m[i] else 0 for i in (1, 2, 3)]
        total, left = Counter(), defaultdict(float)
        for g, x in c.items():
            total[g[:-1]] += x
            left[g[:-1]] += d[min(x, 3)]
        tables[n] = (c, d, total, left)

    def p(g):
        if not g:
            return 1 / SYMBOLS
        c, d, total, left = tables[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        return (max(c[g] - d[min(c[g], 3)], 0) + left[g[:-1]] * p(g[1:])) / total[g[:-1]]

    return p


def code(g):
    return sum(x << (8 * (ORDER - 1 - i)) for i, x in enumerate(g))


def some_texts(rng, n):
    return ["".join(rng.choice("aab  ,é\nXx!日本") for _ in range(rng.randint(1, 120))) for _ in range(n)]


def test_probabilities_against_the_definition_and_they_sum_to_one(spark):
    rng = random.Random(1)
    texts = some_texts(rng, 30)
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "fold int, text string").repartition(3)
    tables = model_tables(count_grams(df, 2))
    lookups = quality.collected(tables, 2)
    seen = sorted({x for t in texts for x in t.encode()})
    for model, own in ((0, texts[1::2]), (1, texts[::2]), (2, texts)):
        p = plain_model(own)
        wanted = [tuple(rng.choice(seen) for _ in range(ORDER)) for _ in range(200)] + [g for t in texts[:4] for g in plain_grams(t)]
        want = [math.log(max(p(g), math.exp(quality.FLOOR))) for g in wanted]
        assert np.allclose(lookups[model].log_probabilities(np.array([code(g) for g in wanted])), want, rtol=1e-9)
        asked = spark.createDataFrame(sorted({(model, code(g)) for g in wanted}), "model int, gram long")
        joined = {r.gram: r.logp for r in quality.joined_scores(asked, tables).collect()}
        assert all(math.isclose(joined[code(g)], x, rel_tol=1e-9) for g, x in zip(wanted, want))
        context = wanted[0][:-1]
        assert math.isclose(sum(p((*context, x)) for x in range(256)), 1, rel_tol=1e-9)


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 5, 50, 400):
        text = "".join(rng.choice("ab \nzé") for _ in range(n))
        want = [code(g) for g in plain_grams(text)]
        for size in (3, 7, 1 << 20):
            monkeypatch.setattr(quality, "PART", size)
            assert [int(x) for part in quality.grams(text) for x in part] == want


def test_perplexities_quantiles_and_keep_against_the_definition(spark):
    """The whole result by brute force, in both ways of looking up; three scripts."""
    rng = random.Random(4)
    docs = [(i, t, ("en", "ja", None)[i % 3], i) for i, t in enumerate(some_texts(rng, 60))] + [(60, "Добрый день, как дела", "ru", 0), (61, "Добрый вечер", "ru", 0)]
    good = {i for i in range(60) if i % 4} | {60}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, model int")
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(61)], "doc_id long, quality int")
    fold = {r.doc_id: r.f for r in spark.range(62).selectExpr("id as doc_id", "pmod(xxhash64(id, 'fold'), 2) as f").collect()}

    def nats(p, text):
        g = plain_grams(text)
        return -sum(math.log(max(p(x), math.exp(quality.FLOOR))) for x in g) / len(g)

    p_all = plain_model([t for i, t, *_ in docs if i in good])
    p_fold = [plain_model([t for i, t, *_ in docs if i in good and fold[i] != f]) for f in (0, 1)]
    held = defaultdict(list)
    for i, t, lang, _ in docs:
        if i in good:
            held[lang].append(nats(p_fold[fold[i]], t))
    limits = {lang: (math.floor(sorted(x)[math.ceil(len(x) * 0.9) - 1] * 1000) + 1) / 1000 for lang, x in held.items()}
    for how in ({}, {"broadcast_rows": 0, "block_bytes": 500}):
        got = {r.doc_id: r for r in judge(df, labels, quantile=0.9, **how).collect()}
        assert len(got) == len(docs)
        for i, t, lang, _ in docs:
            want = nats(p_all, t)
            assert math.isclose(got[i].perplexity, math.exp(want), rel_tol=1e-9) and got[i].n_symbols == len(plain_grams(t))
            assert math.isclose(got[i].threshold, math.exp(limits[lang]), rel_tol=1e-9)
            assert got[i].keep == (want <= limits[lang])


def test_query_keeps_good_documents_and_drops_bad_ones(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op6_quality(spark, sf).collect()}
    labels = table(spark, sf, "labels").collect()
    good, bad = [rows[r.doc_id].keep for r in labels if r.quality == 1], [rows[r.doc_id].keep for r in labels if r.quality == 0]
    assert len(rows) == 1000 and sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2


def test_nulls_empty_clashing_columns_and_no_labels(spark):
    rows = [(i, "the cat sat on the mat and it was good " * (1 + i % 3), "en", 0.5) for i in range(60)]
    rows += [(100, None, "en", 0.5), (101, "", "en", 0.5), (102, " \n ", None, 0.5), (103, "Ж%$#@" * 30, "en", 0.5), (103, "Ж%$#@" * 30, "en", 0.5), (None, "the cat sat on the mat", "xx", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(5, 0, 0), (103, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = judge(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].keep for i in range(60)) and not by[103].keep
    assert by[100].perplexity is None and not by[100].keep and not by[101].keep and by[None].keep and by[None].threshold is None
    free = judge(docs, labels.limit(0)).collect()
    assert {round(r.perplexity) for r in free if r.perplexity} == {SYMBOLS}
    assert judge(docs.limit(0), labels).count() == 0
