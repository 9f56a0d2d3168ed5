from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from siltstone.llm import divergence
from siltstone.llm.divergence import TERM_BYTES, audit_sources


def brute(docs, least_docs, ranks):
    """The audit by plain loops over every kept term of every group."""
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in held:
        kept = sorted((t for t, n in held[lang].items() if n >= least_docs), key=lambda t: t.encode())
        v, shares = len(kept), {}
        counts = {g: {t: c[t] for t in kept} for g, c in groups.items() if g[0] == lang}
        counts[None] = {t: sum(c[t] for c in counts.values()) for t in kept}
        for g, c in counts.items():
            shares[g] = {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v) for t in kept}
        own = [g for g in counts if g]
        for g in own:
            pairs = [(sum(abs(shares[g][t] - shares[h][t]) for t in kept), h[1]) for h in own if h != g]
            terms = [(shares[g][t] - shares[None][t], t) for t in kept if counts[g][t] and shares[g][t] > shares[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((*g, part, item, value, i))
    return sorted(out)


def docs(n, sources, seed=1):
    rnd = random.Random(seed)
    words = ["The", "the", "été", "ÉTÉ", "日本", "a", "b-c", "x1y", "Straße", "\U0001f600", "q r", "z\x00w"] + [f"{c}{d}" for c in "klm" for d in "nop"]
    return [(" ".join(rnd.choices(words, k=rnd.randint(0, 12))) if rnd.random() < 0.95 else None, rnd.choice(["en", "fr", None, ""]), rnd.choice([*sources, None])) for _ in range(n)]


SCHEMA = "text string, lang string, source string"


@pytest.mark.parametrize(("tile", "bucket"), [(256, 32_768), (2, 7)])
def test_against_brute_force(spark, monkeypatch, tile, bucket):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", bucket)
    rows = docs(300, [f"s{i}" for i in range(6)])
    rows += [("solo " * 3, "de", "only"), ("", "it", "a"), (None, "it", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in audit_sources(df, least_docs=12, ranks=4).collect())
    assert got == brute(rows, 12, 4)
    assert [r for r in got if r[0] == "it"] == [("it", "a", "pair", "b", 0, 1), ("it", "b", "pair", "a", 0, 1)]
    assert not [r for r in got if r[0] == "de"]


def test_equal_values_of_different_cells_and_ties_in_utf8_order(spark):
    # every term once in its own document: all differences of a group are equal
    rows = [(t, "en", "a") for t in ("b", "é", "\U0001f600", "a", "￮") for _ in range(2)] + [("other " * 50, "en", "c")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    got = audit_sources(df, least_docs=2, ranks=3).filter("part = 'term' AND source = 'a'").orderBy("rank").collect()
    assert [r.item for r in got] == ["a", "b", "é"] and len({r.value for r in got}) == 1 and [r["rank"] for r in got] == [1, 2, 3]


def test_a_flush_in_the_middle_and_repeated_rows(spark):
    rows = docs(200, ["s"]) * 2
    assert sorted(tuple(r) for r in audit_sources(spark.createDataFrame(rows, SCHEMA).repartition(3), 20, 50).collect()) == brute(rows, 20, 50)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame(docs(80, ["s", "t"]), SCHEMA)
    assert audit_sources(df.limit(0)).count() == 0
    more = df.selectExpr("*", "1 AS term", "2 AS n", "3 AS data", "4 AS tile", "'x' AS item")
    plain, clash = (sorted(tuple(r) for r in audit_sources(x, 5, 9).collect()) for x in (df, more))
    assert plain == clash and plain


def test_a_very_long_text(spark):
    df = spark.createDataFrame([("Wort " * 200_000, "de", "a"), ("wort", "de", "b")], SCHEMA)
    got = audit_sources(df, least_docs=2).collect()
    assert {(r.part, r.source, r.item, r.value) for r in got} == {("pair", "a", "b", 0), ("pair", "b", "a", 0)}


def test_term_bytes():
    assert "Äb1C_d\x7fé".encode().translate(TERM_BYTES).split() == ["Äb".encode(), b"c", b"d", "é".encode()]
