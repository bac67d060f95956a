"""A3 planted violations; H1/H2/H6/H7/H16 text rules; H10 retrieval against numpy."""

import numpy as np

from nestegg.operators.integrity import integrity_report, violations
from nestegg.operators.retrieve import filtered_knn
from nestegg.operators.text import intent, is_recommendation, parse_questions


def test_integrity_finds_planted_violations(spark):
    cat = {
        "operator_info": spark.createDataFrame([("O1", "A"), ("O1", "B")], "id string, operator_name string"),
        "product_info": spark.createDataFrame([("X1", "n", None, "P1", "GUARANTEED"), ("X2", "m", None, "P1", "OTHER")],
                                              "id string, product_name string, product_type string, provider_id string, category string"),
        "product_fixed": spark.createDataFrame([("X9", 12, None)], "id string, maturity int, interest_rate decimal(5,2)"),
        "product_mapping": spark.createDataFrame([("X1", "O1", "DB"), ("X1", "O2", "DB"), ("X1", "O2", "DB")],
                                                 "product_id string, operator_id string, subscriber_type string"),
    }
    rep = {(r.table_name, r.rule, r.column_name): r.violations for r in integrity_report(cat).collect()}
    assert rep[("operator_info", "primary_key", "id")] == 1
    assert rep[("product_info", "domain", "category")] == 1
    assert rep[("product_fixed", "foreign_key", "id->product_info.id")] == 1
    assert rep[("product_mapping", "foreign_key", "operator_id->operator_info.id")] == 2
    assert rep[("product_mapping", "primary_key", "product_id,operator_id,subscriber_type")] == 1
    assert rep[("product_info", "not_null", "id")] == 0
    assert violations(cat).count() == sum(rep.values())


def test_parse_questions_length_before_strip(spark):
    text = "  abc \n12345\n123456\n\n 첫 번째 질문인가요? \n두 번째 질문입니다\n세 번째 질문입니다\n네 번째"
    got = spark.createDataFrame([(text,)], "t string").select(parse_questions("t").alias("q")).first().q
    # "  abc " has length 6 > 5 before stripping, so it is kept (stripped to "abc").
    assert got == ["abc", "123456", "첫 번째 질문인가요?"]


def test_intent_and_request(spark):
    rows = [("두 상품 비교해줘",), ("차이가 뭐야",), ("추천",), ("  상품 추천\n",), ("추천해 주세요",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(intent("t").alias("i"), is_recommendation("t").alias("r")).collect()
    assert [r.i for r in got] == ["compare", "compare", "recommend", "recommend", "recommend", "recommend"]
    assert [r.r for r in got] == [False, False, True, True, False, False]


def test_filtered_knn_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(60, 8)).astype("float32")
    cands = {q: sorted(rng.choice(60, size=7, replace=False).tolist()) for q in range(20)}
    corpus = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(60)], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(q, vecs[q].tolist(), cands[q]) for q in cands],
                                    "query_id long, qvec array<float>, cand_ids array<long>")
    got = {}
    for r in filtered_knn(queries, corpus, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    for q, ids in cands.items():
        d = [(float(((vecs[q].astype("float64") - vecs[i].astype("float64")) ** 2).sum()), i) for i in ids]
        exp = [i for _, i in sorted(d)[:3]]
        assert [i for _, i in sorted(got[q])] == exp
