"""One id on most rows: the mixture spreads it, deduplication keeps the columns and a row a group."""

from pyspark.sql import functions as F

from nestegg.llm import mixing as mx
from nestegg.llm import simhash as sh


def test_mixing_spreads_a_repeated_id(spark):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
                                    F.lit("one").alias("source"), F.concat_ws(" ", F.lit("w"), F.col("id")).alias("text"))
    mixed = mx.mix(docs, [3, 1, 2])
    place = mixed.blocks.join(mixed.sizes, "uid").filter("doc_id = 7").select("block").distinct()
    # 4,000 documents of two words fill 250 blocks; in one stretch they would lie in 251 of the 375.
    assert place.count() > 350
    again = mx.taken_words(mx.mix(docs, [3, 1, 2]))
    assert mx.taken_words(mixed).exceptAll(again).isEmpty() and again.agg(F.sum("taken")).first()[0] == 18000


def test_sequence_spans_cover_every_slot(spark, monkeypatch):
    monkeypatch.setattr(mx, "SLOT_CHUNK", 8)
    monkeypatch.setattr(mx, "CHUNK_SPAN", 4)
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c d e f g").alias("text"))
    mixed = mx.mix(docs, [1], block_words=2)
    row = mixed.recipe.first()
    assert mixed.slots.count() == row.n_slots == mixed.slots.select("shard", "position").distinct().count()


def test_deduplicate_with_clashing_columns(spark):
    rows = [(1, "a b c d e", 1), (2, "a b c d e", 2), (None, None, 3), (3, "", 4), (None, "x y z u v w", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_root int")
    docs = docs.withColumn("fp", F.lit(0)).withColumn("uid", F.lit(0)).withColumn("gone_uid", F.lit(0)).withColumn("root", F.lit(0))
    kept = sh.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.component_root for r in kept.collect()) == [1, 4, 5]
    assert sh.deduplicate(docs.limit(0)).isEmpty()
