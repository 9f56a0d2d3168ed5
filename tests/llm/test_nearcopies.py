from __future__ import annotations

import random

import corpus_pipeline as cp
from siltstone.llm.nearcopies import near_copies


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_classes(texts):
    """Smallest id reachable over all pairs with a similarity of 0.8 or more."""
    sets, parent = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in texts}


def corpus():
    """Pairs just above and just below the similarity, long and short, chains, and texts that repeat their lines."""
    rng, out = random.Random(11), []
    w = lambda n: [f"w{rng.randint(0, 9999)}" for _ in range(n)]
    for g in range(150):
        n = rng.choice([8, 9, 12, 30, 100, 300])
        base = w(n)
        out.append(base)
        # replacing the last e words replaces e shingles
        for want in (0.80, 0.83, 0.78, 0.74)[: 1 + g % 4]:
            shared = n - 4
            e = round(shared * (1 - want) / (1 + want))
            out.append(base[: n - e] + w(e))
        if g % 10 == 0:
            out.append(base * rng.randint(2, 9) if n > 100 else base[:-1])
    return {i: " ".join(x) for i, x in enumerate(out)}


def test_stage_against_all_pairs(spark, sf_dir):
    texts = corpus()
    want = plain_classes(texts)
    assert 100 < sum(want[d] != d for d in texts) < len(texts) - 160
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_dedup(spark, docs, sf_dir).collect()} == {d for d in texts if want[d] == d}
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    assert got == want


def test_large_groups_in_pieces(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(90):
        t = base[:]
        t[rng.randrange(60)] = f"x{i}"
        t[-rng.randint(1, 6) :] = [f"y{i}"]
        texts[i] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for piece in (7, 30, 4096):
        assert {r.doc_id: r.component_id for r in near_copies(df, max_tree=20, piece=piece).collect()} == plain_classes(texts)


def test_pairs_at_the_similarity_are_found(spark):
    """Recall on pairs between 0.80 and 0.84, most of them hard: of all such pairs at least 0.98 (no other links)."""
    rng, texts, pairs = random.Random(23), {}, []
    for g in range(1500):
        n = rng.choice([13, 22, 49, 120, 250])
        base = [f"w{rng.randint(0, 99_999)}" for _ in range(n)]
        other = base[:]
        e = max(1, (n - 4) // 9)  # the last e words change e shingles
        other[n - e :] = [f"x{rng.randint(0, 99_999)}" for _ in range(e)]
        a, b = 2 * g, 2 * g + 1
        texts[a], texts[b] = " ".join(base), " ".join(other)
        if 0.8 <= jaccard(shingles(texts[a]), shingles(texts[b])) <= 0.84:
            pairs.append((a, b))
    assert len(pairs) > 1000
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)
    assert all(got[a] in (a, a - a % 2) for a in texts)


def test_ids_with_different_texts_and_repeated_rows(spark, sf_dir):
    a, b = "one two three four five six seven", "quite another text with other words in it"
    rows = [(1, a, "en", "x", 1), (1, b, "en", "x", 2), (2, a, "en", "x", 3), (1, a, "en", "y", 4), (1, a, "en", "x", 1), (None, b, "en", "x", 6), (None, "alone here", None, None, None), (7, None, "en", "x", 8), (8, "", "en", "x", 9)]
    docs = spark.createDataFrame([(*r, "kept", i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, member string, doc long")
    out = cp.near_dedup(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in out.collect())
    assert got == sorted([(1, a, 1), (1, b, 2), (0, "alone here", 0), (7, "", 8)]) and {r.member for r in out.collect()} == {"kept"}
    assert cp.near_dedup(spark, docs.limit(0), sf_dir).count() == 0
