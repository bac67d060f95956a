"""H12-H18 on the smallest driver tables: layout by intent, retrieval restricted to the user's products."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_chat_prompts_layout_and_restriction(spark):
    from nestegg import constants as K
    from nestegg.operators import retrieve as R
    from nestegg.operators.chat import chat_prompts, portfolio_texts, recommended_corpus
    from nestegg.plans.queries import Context

    ctx = Context(spark, SF)
    docs = ctx.embedded_documents
    turns = ctx.user_turns()
    # One synthetic request turn per user on top of the real turns, to cover both layouts.
    req = ctx.profiles.select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"),
                              "user_id", F.lit(" 추천해주세요 ").alias("query"))
    out = chat_prompts(turns.unionByName(req), ctx.chat_portfolio, docs, ctx.embedder).collect()
    assert out
    for r in out:
        human = r.messages[1].content
        assert r.messages[0].role == "system" and r.messages[1].role == "human"
        if r.conv_id == -1:
            assert "[추천 포트폴리오]" in human and "[검색된 상세 정보]" not in human
        else:
            assert "[검색된 상세 정보]" in human and K.REASON_BLOCK_HEAD.strip() in human
    # Retrieval never leaves the user's own recommended products and returns at most k.
    pt = portfolio_texts(ctx.chat_portfolio)
    q = R.embed(turns.join(pt, "user_id"), ctx.embedder, text_col="query", out="qvec")
    corpus = recommended_corpus(ctx.chat_portfolio, docs).select(F.col("product_id").alias("doc_id"), "embedding")
    hits = R.filtered_knn(q.select("conv_id", "turn", "qvec", "cand_ids"), corpus, 3, ["conv_id", "turn"])
    chk = hits.join(q.select("conv_id", "turn", "cand_ids"), ["conv_id", "turn"])
    assert chk.where(~F.array_contains("cand_ids", F.col("doc_id"))).count() == 0
    assert chk.groupBy("conv_id", "turn").count().where("count > 3").count() == 0


def test_embedder_keeps_the_terms_of_a_large_vocabulary_apart(spark):
    """A query of one term is nearest to the only document that has it, and equally far from all others."""
    from nestegg.operators import retrieve as R

    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("낱말"), F.lpad("id", 4, "0")).alias("page_content"))
    vectors, model = R.build_vector_table(docs)
    ids = docs.agg(F.sort_array(F.collect_list("doc_id")).alias("cand_ids"))
    queries = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), F.col("page_content").alias("query"))
    queries = R.embed(queries, model, text_col="query", out="qvec").crossJoin(ids)
    hits = R.filtered_knn(queries, vectors.select("doc_id", "embedding"), 3).collect()
    for r in hits:
        others = [i for i in range(3) if i != r.query_id]
        assert r.doc_id == (r.query_id if r["rank"] == 1 else others[r["rank"] - 2])
        assert abs(r.distance - (0 if r["rank"] == 1 else 2)) < 1e-9
    assert len(hits) == 600
