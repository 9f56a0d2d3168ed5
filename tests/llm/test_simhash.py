from __future__ import annotations

import random
import re

import xxhash

from siltstone.llm import simhash
from siltstone.llm.simhash import add_fingerprint, block_keys, connected, near_duplicates, near_links, op4_simhash
from siltstone.sources.tables import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text: str | None, k: int = 3) -> int:
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints: dict[int, int], radius: int = 2) -> dict[int, int]:
    """Smallest id reachable over links between all pairs."""
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_query_against_all_pairs(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    classes = plain_classes(prints)
    rows = op4_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == {i: (prints[i], classes[i]) for i in texts}
    assert all(len(r.fingerprint) == 16 for r in rows) and len(rows) == len(texts)


def test_xxhash_is_sparks(spark):
    row = spark.sql("select xxhash64('aé b c') h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("aé b c".encode(), 42)


def test_dense_clusters_in_small_trees(spark):
    rng = random.Random(1)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = {i: x for i, x in enumerate(sorted(prints))}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints.values()], "node long")
    want = plain_classes(prints)
    for max_tree in (7, 4096):
        roots = {r.node: r.root for r in connected(near_links(df.withColumns({"p0": df.node, "keys": block_keys(df.node, 2)}), 2, max_tree)).collect()}
        got = {i: roots.get(signed(x), signed(x)) for i, x in prints.items()}
        for i in prints:
            for j in prints:
                assert (got[i] == got[j]) == (want[i] == want[j])


def test_a_long_chain_contracts(spark, monkeypatch):
    df = spark.range(500).selectExpr("id as a", "id + 1 as b")
    assert connected(df).select("root").distinct().count() == 1
    monkeypatch.setattr(simhash, "FEW", 20)
    assert connected(df).select("root").distinct().count() == 1


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 40)
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 50, 300):
        text = "  ".join(rng.choice(["Ab", "É", "ccc", "d e", "F" * 60]) for _ in range(n)) + "\n"
        assert simhash.fingerprint(text, 3) == plain_fingerprint(text)


def test_nulls_empty_repeats_and_clashing_columns(spark):
    rows = [(3, None, 1), (4, "", 1), (9, " \t", 1), (5, "a", 1), (5, "a", 1), (None, "a", 1), (7, "completely different words are here", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(df).collect())
    assert got == [(-1, 5), (3, 3), (4, 3), (5, 5), (5, 5), (7, 7), (9, 3)]
    assert near_duplicates(df.limit(0)).count() == 0
    assert add_fingerprint(df.limit(0).select("doc_id", "text")).count() == 0
