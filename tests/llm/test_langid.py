from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from siltstone.llm import langid
from siltstone.llm.langid import Pool, cut, fit, init, op7_language_id, predict, step
from siltstone.sources.tables import table


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in init(3, 4, rng).items()}
    windows, labels = rng.integers(97, 110, (12, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, g = step(p, windows, labels)
    for k in p:
        at = tuple(rng.integers(0, s) for s in p[k].shape)
        at = (int(windows[3, 2]), at[1]) if k[0] == "x" else at
        old, sides = p[k][at], []
        for d in (1e-4, -1e-4):
            p[k][at] = old + d
            sides.append(step(p, windows, labels)[0])
        p[k][at] = old
        assert abs((sides[0] - sides[1]) / 2e-4 - g[k][at]) < 2e-4


def test_windows_label_every_byte_once():
    for n in (1, 100, 191, 192, 193, 368, 369, 5000):
        data = bytes(1 + i % 250 for i in range(n))
        windows, lo, hi = cut(data)
        assert b"".join(w[a:b].tobytes() for w, a, b in zip(windows, lo, hi)) == data


def test_pool_is_the_same_however_texts_are_batched(monkeypatch):
    p = init(3, 4, np.random.default_rng(1))
    texts = [bytes(97 + (i * j) % 20 for j in range(1 + 97 * i)) for i in range(30)]
    whole = Pool(p)
    for i, t in enumerate(texts):
        whole.add(i, t)
    whole = whole.take()
    monkeypatch.setattr(langid, "TOGETHER", 3)
    for i, t in enumerate(texts):
        one = Pool(p)
        one.add(0, t)
        assert np.allclose(one.take()[0], whole[i], atol=1e-5) and abs(whole[i].sum() - 1) < 1e-5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    rows = op7_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_und_nulls_empty_and_clashing_columns(spark):
    rows = [(1, "the and of with", "en", 9), (2, "der die das und", "de", 9), (3, None, "en", 9), (4, "12 34 !!", "en", 9), (5, "", None, 9), (5, "", None, 9), (6, "the and " * 50_000, "en", 9), (7, "½ ²", "en", 9), (8, "Ⅷ ٣ ①", None, 9), (9, "日", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model, languages = fit(df.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in predict(df, model, languages).collect()}
    assert languages == ["de", "en"] and [got[i].lang_pred for i in (3, 4, 5, 7, 8)] == ["und"] * 5 and {got[i].score for i in (3, 4, 5, 7, 8)} == {0}
    assert got[6].lang_pred == "en" and got[9].lang_pred != "und" and predict(df, model, languages).count() == 10
    model, languages = fit(df.filter("lang IS NULL").select("doc_id", "text", "lang"))
    assert model is None and {r.lang_pred for r in predict(df, model, languages).collect()} == {"und"}
    assert predict(df.limit(0), model, languages).count() == 0


def test_scores_against_loops_over_bytes(spark):
    """Every position by scalar loops over the gates, whole texts, means over all positions."""
    p = langid.init(3, 2, np.random.default_rng(5))
    clip = lambda x, lo, hi: max(lo, min(hi, x))

    def states(d, data):
        x, u, c, h, out = p["x" + d], p["u" + d], p["c" + d], [0.0, 0.0], []
        for byte in data if d == "f" else data[::-1]:
            b = [sum(float(u[i][k]) * h[k] for k in range(2)) + float(c[i][0]) for i in range(6)]
            a = [float(v) for v in x[byte]]
            r = [clip((a[i] + b[i]) / 4 + 0.5, 0, 1) for i in range(2)]
            z = [clip((a[2 + i] + b[2 + i]) / 4 + 0.5, 0, 1) for i in range(2)]
            m = [clip(a[4 + i] + r[i] * b[4 + i], -1, 1) for i in range(2)]
            h = [m[i] + z[i] * (h[i] - m[i]) for i in range(2)]
            out.append(h)
        return out if d == "f" else out[::-1]

    def means(data):
        inner, sums, n = langid.WINDOW - 2 * langid.MARGIN, [0.0] * 3, 0
        starts = list(range(0, max(1, len(data) - 2 * langid.MARGIN), inner)) or [0]
        for at in starts:
            window = data[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            f, b = states("f", window), states("b", window)
            lo = 0 if at == 0 else langid.MARGIN
            hi = len(data) - at if at == starts[-1] else langid.WINDOW - langid.MARGIN
            for t in range(lo, hi):
                s = [sum(float(p["o"][k][i]) * (f[t] + b[t])[i] for i in range(4)) + float(p["q"][k][0]) for k in range(3)]
                e = [math.exp(v - max(s)) for v in s]
                sums, n = [x + y / sum(e) for x, y in zip(sums, e)], n + 1
        assert n == len(data)
        return [x / n for x in sums]

    texts = ["a", "Héllo wörld", "x" * 191, "some words " * 40, "zé " * 150]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(df, p, ["a", "b", "c"]).collect()}
    for i, t in enumerate(texts):
        want = means(t.encode())
        assert got[i].score == pytest.approx(max(want), rel=1e-4) and got[i].lang_pred == "abc"[want.index(max(want))]


def test_more_languages_than_the_sample_holds(spark):
    df = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="5 languages"):
        fit(df, most_documents=4)
    assert len(langid.training_windows(df, 300, 4, 5)[2]) == 5
