"""A training corpus from `documents`: five stages, each written and read again by the next one's caller.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of docs. docs may have more columns than `documents`, of any name; their values are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.decontaminate import without_contaminated
from siltstone.llm.langid import fit, predict
from siltstone.llm.mixing import mix_sources
from siltstone.llm.nearcopies import near_copies
from siltstone.llm.sharding import assign_shards
from siltstone.llm.shared import spare, stored, word_count
from siltstone.llm.simhash import BROADCAST_ROWS
from siltstone.sources.tables import table

#: A document is rejected if its language is unknown or less likely than this.
LEAST_SCORE = 0.4
SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of unknown or doubtful language; a null lang is filled in.

    Null texts and texts without a letter have no language and go; a text of any length is read whole; repeated rows are
    judged alike; an empty table gives an empty one. Without any document whose language is given there is nothing to
    learn from, and only null texts are rejected.
    """
    model, languages = fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.filter("text IS NOT NULL")
    lang, score = spare(docs, "lang_pred", "score")
    told = predict(docs, model, languages, lang=lang, score=score)
    kept = told.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: the one with the smallest doc_id.

    Rows with one doc_id and one text are one document, of which the least row stays; rows that share a doc_id and differ
    in text are different documents, and of a class's documents with the smallest doc_id the one stays whose text has the
    smallest hash. A null doc_id comes after all others; null texts are copies of each other and of texts without a
    word; an empty table gives an empty one; texts are read whole.
    """
    member, doc = spare(docs, "member", "doc")
    classes = stored(near_copies(docs.select("doc_id", "text")), "classes")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("member") == F.col("component_member"))
    named = lambda df: df.select(F.col("doc_id").alias(doc), F.col("member").alias(member))
    away = stored(named(classes.filter(~stays)).distinct(), "copies")
    repeated = stored(named(classes.filter(stays).groupBy("doc_id", "member").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")), "repeated")

    def match(kind: str, rows: DataFrame, keys: DataFrame) -> DataFrame:
        same = F.xxhash64(rows["text"]).eqNullSafe(keys[member]) & rows["doc_id"].eqNullSafe(keys[doc])
        return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, same, kind)

    kept = match("left_anti", docs, away)
    if repeated.isEmpty():
        return kept
    one = match("left_semi", kept, repeated).groupBy("doc_id", F.xxhash64("text").alias(member)).agg(F.min(F.struct(*docs.columns)).alias(doc))
    return match("left_anti", kept, repeated).unionByName(one.select(f"{doc}.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found.

    Null and empty texts hold no item and stay; texts are read whole; rows that share a doc_id go together if the item is in
    one of them, null doc_ids among each other too; repeated rows are judged alike; an empty table gives an empty one and
    an empty benchmark drops nothing.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target wants it: 0 to 3 times.

    Rows that agree in doc_id, source and size get the same number of copies, the mean of theirs; a null source is a source,
    a null doc_id an id; null texts and texts without a word have size 0, take no words and stay once; an empty table
    gives an empty one; texts are counted whole.
    """
    doc, source, size, wanted, copy = spare(docs, "doc", "of_source", "size", "wanted", "copy")
    copies = mix_sources(docs.select("doc_id", "source", "text")).groupBy("doc_id", "source", "size").agg((F.sum("copies") / F.count(F.lit(1))).alias("c"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    dealt = copies.select(key("doc_id").alias(doc), key("source").alias(source), F.col("size").alias(size), F.round("c").cast("int").alias(wanted)).filter(F.col(wanted) > 0)
    keyed = docs.withColumns({doc: key("doc_id"), source: key("source"), size: word_count(F.col("text"))})
    found = keyed.join(dealt, [doc, source, size])
    return found.select(*docs.columns, F.explode(F.array_repeat(F.lit(True), F.col(wanted))).alias(copy)).drop(copy)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each row, by its doc_id; a column `shard` that docs has already is replaced.

    A null doc_id is a key of its own, repeated ids share a shard, texts are not read, an empty table gives an empty one.
    """
    return assign_shards(docs, "doc_id", SHARDS)


STAGES = [("language ID", language), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing sources", mix), ("sharding", shard)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else stored(docs, "stage")
    return docs
