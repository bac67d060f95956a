"""Samples stay bounded when one id stands on most rows; blocks of items give what one block gives."""

from pyspark.sql import functions as F

from nestegg.llm import common as cm
from nestegg.llm import decontaminate as dc
from nestegg.llm import language as lg


def test_one_labelled_id_on_most_rows(spark):
    many = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = many.unionByName(spark.createDataFrame([(2, "two"), (3, None), (None, "x")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1)], "doc_id long, toxic int")
    got = cm.labelled_documents(docs, labels, "toxic", 100)
    assert got.columns == ["text", "label"]
    rows = sorted(map(str, got.collect()))
    assert len(rows) == cm.ROWS_OF_ID + 2
    assert rows == sorted(map(str, cm.labelled_documents(docs.repartition(3), labels, "toxic", 100).collect()))


def test_language_sample_is_bounded_by_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(lg, "learned_tree", lambda texts, order: seen.setdefault(len(seen), len(texts)))
    many = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    few = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("texte "), F.col("id")).alias("text"), F.concat(F.lit("l"), F.col("id")).alias("lang"))
    models = lg.learn_models(many.unionByName(few))
    assert len(models.languages) == 41 and max(seen.values()) <= lg.SAMPLE_DOCS


def test_items_in_blocks_give_the_same_spans(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(14))) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 3 + j) % 50}" for j in range(80))) for i in range(60)], "doc_id long, text string")
    one = dc.contamination(docs, items).select("doc_id", "n_words", "n_hit", "spans", "items")
    many = dc.contamination(docs, items, block_bytes=300).select("doc_id", "n_words", "n_hit", "spans", "items")
    assert dc.item_blocks(items, "item_id", "text", 300)[1] > 2
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    cut = lambda n: sorted(map(str, dc.decontaminate(docs, items, block_bytes=n).collect()))
    assert cut(300) == cut(1 << 20)
