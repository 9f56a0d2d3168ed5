from __future__ import annotations

import zlib
from collections import Counter

from siltstone.llm import sharding
from siltstone.llm.sharding import assign_shards, give_slots, op10_rendezvous_sharding
from siltstone.sources.tables import table


def test_slots_sizes_and_growth(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = op10_rendezvous_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for shard, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 24)


def test_weights_share_and_few_rows_move(spark):
    df = spark.range(20_000)
    got = Counter(r.shard for r in assign_shards(df, "id", 3, [1, 1, 2]).collect())
    assert abs(got[2] - 10_000) < 400 and abs(got[0] - 5_000) < 300
    both = assign_shards(assign_shards(df, "id", 5, shard="a"), "id", 6, shard="b")
    moved = both.filter("a <> b")
    assert moved.filter("b <> 5").count() == 0 and abs(moved.count() - 20_000 / 6) < 300


def test_null_keys_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "x")] * 3 + [(7, "y")] * 5000, "id long, size string")
    out = assign_shards(df, "id", 4)
    assert out.columns == ["id", "size", "shard"] and out.filter("id = 7").select("shard").distinct().count() == 1
    slots = give_slots(out.select("id", "shard"), "shard", 4).collect()
    for shard, n in Counter(r.shard for r in slots).items():
        assert sorted(r.slot for r in slots if r.shard == shard) == list(range(n))
    assert give_slots(out.select("id", "shard").limit(0), "shard", 4).count() == 0


def test_very_different_rows_under_one_null_key(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 50)
    df = assign_shards(spark.range(2000).selectExpr("CAST(NULL AS LONG) AS id", "id AS x"), "id", 3)
    (shard,) = {r.shard for r in df.select("shard").distinct().collect()}
    out = give_slots(df, "shard", 3).collect()
    assert sorted(r.slot for r in out) == list(range(2000)) and {r.shard for r in out} == {shard} and {r.x for r in out} == set(range(2000))
