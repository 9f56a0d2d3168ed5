from __future__ import annotations

import random

from siltstone.llm import decontaminate, shared
from siltstone.llm.decontaminate import contaminated, op8_decontaminate, tiles, without_contaminated
from siltstone.sources.tables import table


def tokens(text):
    """Lower-case words, ASCII punctuation being white space, by the definition."""
    plain_text = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (text or "").lower())
    return plain_text.split()


def naive_tiles(doc, item, least):
    """Greedy string tiling by its definition: the longest match of unmarked tokens, the first one of these, again and again."""
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_doc[i + n] and free_item[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least or not n:
            return out
        free_doc[i : i + n] = free_item[j : j + n] = [False] * n
        out.append((i, j, n))


def plain(docs, items, least=5, coverage=0.8):
    """Tiles every item on the whole of every document that has any of its runs of `least` words."""
    out, doc_tokens = [], [(d, tokens(t)) for d, t in docs]
    runs = [(d, t, {}) for d, t in doc_tokens]
    for item, text in items:
        words = tokens(text)
        n = min(least, len(words))
        seeds = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
        for d, t, known in runs:
            have = known.setdefault(n, {tuple(t[i : i + n]) for i in range(len(t) - n + 1)})
            if not seeds.isdisjoint(have):
                # what is in no shared run matches nothing
                near = sorted({x for i in range(len(t) - n + 1) if tuple(t[i : i + n]) in seeds for x in range(i, i + n)})
                short = [y for k, x in enumerate(near) for y in ([None] if k and near[k - 1] != x - 1 else []) + [t[x]]]
                covered = sum(x[2] for x in naive_tiles(short, words, n))
                if covered >= coverage * len(words):
                    out.append((d, item, len(words), covered))
    return sorted(out, key=str)


def test_tiles_against_the_definition():
    rng = random.Random(6)
    for _ in range(300):
        doc, item = [rng.randint(0, rng.choice([2, 4])) for _ in range(rng.randint(0, 40))], [rng.randint(0, 3) for _ in range(rng.randint(1, 25))]
        assert sorted(tiles(doc, item, 3)) == sorted(naive_tiles(doc, item, 3))


def test_many_seeds_go_through_the_split_join(spark, monkeypatch):
    """Beyond the broadcast limits the result is the same."""
    rng = random.Random(9)
    w = lambda n: [f"w{rng.randint(0, 50)}" for _ in range(n)]
    items = [(i, " ".join(w(rng.randint(6, 20)))) for i in range(30)]
    docs = [(d, " ".join(w(20) + rng.choice(items)[1].split() + w(20))) for d in range(60)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(shared, "KEY_ROWS", 3)
    got = sorted(((r.doc_id, r.item_id, r.n_words, r.covered) for r in contaminated(a, b).collect()), key=str)
    assert got == plain(docs, items) and len(got) >= 60


def test_tiles_do_not_overlap_and_match():
    rng = random.Random(2)
    for _ in range(200):
        doc, item = [rng.randint(0, 3) for _ in range(40)], [rng.randint(0, 3) for _ in range(25)]
        found = tiles(doc, item, 3)
        for side in (0, 1):
            used = [x for t in found for x in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used))
        assert all(doc[i : i + n] == item[j : j + n] and n >= 3 for i, j, n in found)
        free_doc = [None if any(i <= x < i + n for i, _, n in found) else t for x, t in enumerate(doc)]
        free_item = [None if any(j <= x < j + n for _, j, n in found) else t for x, t in enumerate(item)]
        windows = {tuple(free_item[x : x + 3]) for x in range(23)}
        assert not any(None not in (w := tuple(free_doc[x : x + 3])) and w in windows for x in range(38))


def test_longest_first():
    assert sorted(tiles([1, 2, 3, 9, 1, 2, 3, 4], [1, 2, 3, 4], 3)) == [(4, 0, 4)]


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = sorted(((r.doc_id, r.item_id, r.n_words, r.covered) for r in op8_decontaminate(spark, sf).collect()), key=str)
    assert got == plain(docs, items) and len(got) > 3


def test_reordered_changed_short_null_and_repeated(spark):
    rng = random.Random(4)
    w = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    item, noise = w(40), w(300)
    moved = item[20:] + noise[:7] + item[:20]
    cases = {
        1: " ".join(noise[:50] + item + noise[50:]), 2: " ".join(noise + moved).upper().replace(" ", ", "), 3: " ".join(item[:25] + noise),
        4: " ".join(noise), 5: None, 6: "", 7: "x Tiny Item. y", 8: "tiny x item", 9: " ".join((noise + ["tiny", "item"]) * 300),
    }
    rows = [(d, t, 1) for d, t in cases.items()] + [(1, cases[1], 1), (None, cases[1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = [(10, " ".join(item)), (11, " ".join(item)), (12, "tiny item"), (13, ""), (14, None), (15, "ha " * 30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 2, None) for i in (10, 11)] + [(7, 12), (9, 12)], key=str)
    kept = without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert contaminated(docs, benchmark.limit(0)).count() == 0 and contaminated(docs.limit(0), benchmark).count() == 0
