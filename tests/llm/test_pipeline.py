from __future__ import annotations

from collections import Counter

import corpus_pipeline as cp
from siltstone.llm.decontaminate import contaminated
from siltstone.llm.mixing import mix_sources
from siltstone.llm.sharding import assign_shards
from siltstone.sources.tables import table


def test_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.01"
    docs, kept = table(spark, sf, "documents"), []
    for name, stage in cp.STAGES[:-1]:
        out = cp.stored(stage(spark, docs, sf), "test")
        assert out.columns == docs.columns
        kept.append((docs, out))
        docs = out
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    (a, b) = kept[0]
    assert b.count() >= 0.97 * a.count()
    (a, b) = kept[1]
    texts = {r.doc_id: r.text for r in a.collect()}
    smallest = {}
    for d, t in texts.items():
        smallest[t] = min(d, smallest.get(t, d))
    stay = ids(b)
    assert all(d not in stay for d, t in texts.items() if smallest[t] != d)
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    sets = {d: shingles(t) for d, t in texts.items()}
    gone = [d for d in texts if d not in stay]
    near = lambda d: max(len(sets[d] & sets[o]) / len(sets[d] | sets[o]) for o in texts if o != d)
    assert gone and all(near(d) >= 0.79 for d in gone)
    assert all(len(sets[d] & sets[o]) / len(sets[d] | sets[o]) < 0.81 for d in stay for o in stay if d < o)
    (a, b) = kept[2]
    leaks = {r.doc_id for r in contaminated(a, table(spark, sf, "benchmark")).collect()}
    assert leaks and ids(b) == ids(a.filter(~a.doc_id.isin(list(leaks))))
    (a, b) = kept[3]
    copies = {r.doc_id: r.copies for r in mix_sources(a).collect() if r.copies}
    assert ids(b) == Counter(copies)
    last = cp.shard(spark, docs, sf)
    assert sorted((r.doc_id, r.shard) for r in last.collect()) == sorted((r.doc_id, r.shard) for r in assign_shards(docs, "doc_id", 24).collect())


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    rows = [(1, "the and of with this that", "en", "a", 5), (1, "the and of with this that", "en", "a", 5), (2, None, "en", None, 0), (None, "the and of it was good", "en", "b", 3), (3, "", None, "b", 0), (4, "word " * 30_000, "en", "b", 9), (5, "12 34", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "a benchmark item of some words"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for empty in (False, True):
        df = docs.limit(0) if empty else docs
        for _, stage in cp.STAGES:
            df = cp.stored(stage(spark, df, str(tmp_path)), "test")
        found = {r.doc_id for r in df.collect()}
        assert found <= {1, None, 4} and (not found) == empty


def test_extra_columns_of_any_name_keep_their_values(spark, tmp_path):
    names = ["lang_pred", "score", "member", "doc", "of_source", "size", "wanted", "copy", "best", "__lang", "__id", "__found", "fingerprint", "shard", "_shard"]
    texts = ["the and of with this that and more", "another text of the same kind with words", "quite some other words in the third one", "the and of with this that and more"]
    rows = [(i, t, "en", "ab"[i % 2], len(t), *[f"{n}-{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n}` string" for n in names)]))
    spark.createDataFrame([(1, "a benchmark item of some words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in cp.STAGES:
        out = cp.stored(stage(spark, docs, str(tmp_path)), "test")
        last = name == "sharding"
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == f"{n}-{r.doc_id}" for n in names if not (last and n == "shard"))
        assert out.count() > 0
        docs = out
