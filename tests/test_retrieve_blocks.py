"""Search over the whole corpus by block bounds, and the vector table that is kept up to date."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestegg.operators import retrieve as R


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 20
    x = np.concatenate([c + rng.normal(size=(60, 8)) for c in centres])
    x[5] = x[4]  # equal vectors tie
    rows = [(i, v.tolist(), "payload") for i, v in enumerate(x)] + [(9999, None, "no vector")]
    return x, spark.createDataFrame(rows, "doc_id long, embedding array<double>, text string").repartition(4)


@pytest.mark.parametrize("n_blocks, fetch_k", [(16, 10), (1, 5), (64, 1000)])
def test_global_search_is_exact(spark, clustered, n_blocks, fetch_k):
    x, corpus = clustered
    queries = corpus.where("doc_id % 37 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qvec"))
    got = R.global_nearest(queries, corpus, fetch_k, n_blocks=n_blocks).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.doc_id)
    for q in range(0, len(x), 37):
        d = ((x - x[q]) ** 2).sum(axis=1)
        want = [int(i) for i in np.lexsort((np.arange(len(x)), d))[:fetch_k]]
        assert sorted(found[q]) == sorted(want)
        assert np.allclose(d[found[q]], np.sort(d)[: len(want)])


def test_far_blocks_are_not_read(spark, clustered):
    x, corpus = clustered
    _, blocks = R.vector_blocks(corpus, n_blocks=24)
    queries = corpus.where("doc_id % 37 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qvec"))
    read = R.blocks_to_read(queries, blocks, 5).count()
    assert read < 0.4 * queries.count() * len(blocks)
    assert sum(n for _, _, n in blocks) == len(x)


def test_search_makes_no_row_for_each_pair(spark, clustered, monkeypatch):
    """The nearest of each piece leave the arrays, not every (query, row) of the blocks."""
    x, corpus = clustered
    monkeypatch.setattr(R, "PIECE_ROWS", 100)  # several pieces a block
    queries = corpus.where("doc_id % 37 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qvec"))
    found = R.global_nearest(queries, corpus, 5, n_blocks=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    rows = found.orderBy("query_id", "rank").collect()
    for q in range(0, len(x), 37):
        got = [r for r in rows if r.query_id == q]
        assert [r.doc_id for r in got] == np.lexsort((np.arange(len(x)), ((x - x[q]) ** 2).sum(axis=1)))[:5].tolist()
        assert got[0].text == "payload"


def test_search_with_copies_doubled_ids_and_odd_vectors(spark):
    """Equal distances go by id also in a large group of copies; odd vectors are ranked as by plain expressions."""
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(7, [1.0, 0.0]), (500, [3.0, 0.0]), (501, [float("nan"), 0.0]), (502, [1e200, 0.0]), (503, [0.5, 0.0])]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [float("nan"), 0.0], "c"), (3, None, "d")], "query_id long, qvec array<double>, tag string")
    got = R.global_nearest(queries, corpus, 6, n_blocks=4).orderBy("query_id", "rank", "tag").collect()
    first = [r for r in got if r.query_id == 1]
    assert [r.doc_id for r in first] == [0, 0, 1, 1, 2, 2] and {r.tag for r in first} == {"a", "b"} and {r.distance for r in first} == {0.0}
    assert [r.doc_id for r in got if r.query_id == 2] == [0, 1, 2, 3, 4, 5]
    assert [(r.doc_id, r.distance) for r in got if r.query_id == 3] == [(i, None) for i in range(6)]


def test_piece_equals_sort_of_all_distances():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(200, 16)), 3, axis=0)
    ids = rng.permutation(len(x))
    piece = R.Piece(np.arange(len(x)), R.pa.array(ids), x, 2)
    assert len(piece.x) == 400  # of three copies two can be among the nearest two
    q, r, d = piece.nearest(x[:30])
    for i in range(30):
        all_d = ((x - x[i]) ** 2).sum(axis=1)
        want = np.lexsort((ids, all_d))[:2]
        assert piece.places[r[q == i]].tolist() == want.tolist() and np.allclose(d[q == i], all_d[want])


def test_filter_after_fetch_may_leave_fewer_than_k(spark, clustered):
    x, corpus = clustered
    queries = corpus.where("doc_id = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qvec"), F.array(F.lit(1), F.lit(700)).cast("array<long>").alias("cand_ids"))
    assert [r.doc_id for r in R.filtered_knn(queries, corpus, 2).orderBy("rank").collect()] == [1, 700]
    assert [r.doc_id for r in R.filtered_knn(queries, corpus, 2, fetch_k=60).collect()] == [1]


def test_sparse_vectors_and_an_empty_corpus(spark):
    rows = [(i, {i % 7: 1.0, 10 + i: 0.5}) for i in range(40)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding map<int,double>")
    queries = corpus.where("doc_id < 5").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qvec"))
    got = R.global_nearest(queries, corpus, 1, n_blocks=6).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {(i, i) for i in range(5)}
    assert R.global_nearest(queries, corpus.limit(0), 3).count() == 0


def test_only_changed_texts_are_embedded(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="nestegg-vectors-"), "table")
    docs = spark.range(400).select(F.col("id").cast("string").alias("product_id"), F.concat(F.lit("text "), "id").alias("page_content"))
    seen = []

    def embed(df):
        seen.append(df.count())
        return df.withColumn("embedding", F.array(F.length("page_content").cast("double"), F.crc32("page_content").cast("double")))

    whole = lambda d: sorted(map(str, embed(d).select("product_id", "page_content", "embedding").collect()))
    table = lambda: sorted(map(str, R.read_vector_table(spark, path).select("product_id", "page_content", "embedding").collect()))
    assert R.update_vector_table(docs, path, embed, buckets=16) == {"embedded": 400, "removed": 0, "kept": 0}
    changed = docs.withColumn("page_content", F.when(F.col("product_id").isin("7", "70", "300", "399"), F.concat("page_content", F.lit("!"))).otherwise(F.col("page_content")))
    seen.clear()
    assert R.update_vector_table(changed, path, embed, buckets=16) == {"embedded": 4, "removed": 0, "kept": 396}
    assert seen == [4] and table() == whole(changed)
    fewer = changed.where("product_id not in ('7', '8')").unionByName(spark.createDataFrame([("new", "a new one"), ("null", None)], "product_id string, page_content string"))
    assert R.update_vector_table(fewer, path, embed, buckets=16) == {"embedded": 2, "removed": 2, "kept": 398}
    assert table() == whole(fewer)
    assert R.update_vector_table(fewer, path, embed, buckets=16) == {"embedded": 0, "removed": 0, "kept": 400}
    assert R.update_vector_table(fewer.limit(0), path, embed, buckets=16)["removed"] == 400
    assert table() == []


def test_user_model_is_applied_to_batches(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "page_content string")

    def model(texts):
        return texts.map(lambda t: [float(len(t)), 1.0])

    got = R.embed_with(df, "page_content", model).collect()
    assert {r.page_content: list(r.embedding) for r in got} == {"ab": [2.0, 1.0], "c": [1.0, 1.0]}
