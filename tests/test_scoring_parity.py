"""Segment scoring equals a per-user, product-by-product restatement in plain Python.

The restatement follows the documented per-user flow: eligible products of the
user's operators (distinct), fill or keep missing values, score every product,
sort descending (missing last, ties by product id) and take the first n.
"""

import bisect
import datetime as dt
import random
import re

import pandas as pd
import pytest
from conftest import SURVEY_DDL, survey_row

from nestegg import constants as K
from nestegg.operators.portfolio import Scored, portfolio_flat, recommend
from nestegg.operators.survey import build_profiles

AS_OF = "2026-01-01"


def make_catalog(spark, seed=3):
    rnd = random.Random(seed)
    ops = [("O1", "A"), ("O2", "B"), ("O3", "C")]
    names = ["정부보증채", "은행 예적금", "저축은행 예적금", "발행어음 및 표지어음", "기타", "펀드", "tdf 2040", "TDF혼합"]
    info, fixed, var, mapping = [], [], [], []
    for i in range(1, 81):
        pid = f"X{i:04d}"
        cat = "GUARANTEED" if i % 2 == 0 else "NON_GUARANTEED"
        if i % 23 == 0:
            cat = None
        info.append((pid, f"p{i} {rnd.choice(names)}", rnd.choice(["T1", None]), "P001", cat))
        if i % 2 == 0 and i % 9 != 0:
            fixed.append((pid, rnd.choice([12, 24, None]), rnd.choice([1.5, 2.25, 3.0, 3.0, None, 0.5])))
        if i % 2 == 1:
            launch = rnd.choice([None, dt.date(2016, 1, 1), dt.date(2027, 1, 1), dt.date(2019, 6, 1), dt.date(2024, 3, 3)])
            var.append((pid, rnd.choice(["1등급", "2등급", "3등급", "4등급", "5등급", "6등급", "7등급", "0", "정보없음", None]),
                        rnd.choice(["O", " o ", "X", None]), launch, rnd.choice([None, 100, 200, 200, 300, 5000]),
                        rnd.choice([None, -3.5, 0.0, 4.25, 12.0]), rnd.choice([None, 1.0, 2.0]),
                        rnd.choice([None, 7.5, 8.0]), rnd.choice([0.1, 0.25, 0.25, None, 1.0])))
        for o in rnd.sample(["O1", "O2", "O3"], rnd.randint(1, 3)):
            for st in rnd.sample(["DB", "DC", "IRP"], rnd.randint(1, 2)):
                mapping.append((pid, o, st))
    cat = {
        "operator_info": spark.createDataFrame(ops, "id string, operator_name string"),
        "product_info": spark.createDataFrame(info, "id string, product_name string, product_type string, provider_id string, category string"),
        "product_fixed": spark.createDataFrame(fixed, "id string, maturity int, interest_rate double").selectExpr(
            "id", "maturity", "CAST(interest_rate AS DECIMAL(5,2)) AS interest_rate"),
        "product_variable": spark.createDataFrame(
            var, "id string, risk_level string, eligible_tdf string, launch_date date, total_net_worth long, "
                 "r1 double, r3 double, r5 double, fee double").selectExpr(
            "id", "risk_level", "eligible_tdf", "launch_date", "total_net_worth",
            "CAST(r1 AS DECIMAL(10,3)) AS average_return_1y", "CAST(r3 AS DECIMAL(10,3)) AS average_return_3y",
            "CAST(r5 AS DECIMAL(10,3)) AS average_return_5y", "CAST(fee AS DECIMAL(5,3)) AS total_expense_ratio"),
        "product_mapping": spark.createDataFrame(mapping, "product_id string, operator_id string, subscriber_type string"),
    }
    pdf = {k: v.toPandas() for k, v in cat.items()}
    return cat, pdf


def make_users(spark):
    rows, rnd = [], random.Random(11)
    for i in range(60):
        rows.append(survey_row(i, age=rnd.randint(20, 70), period=rnd.randint(0, 15), experience=rnd.randint(1, 6),
                               psychology=rnd.randint(1, 3), loss_level=rnd.randint(1, 4),
                               finance_knowledge=rnd.randint(1, 4), investment_goal=rnd.randint(1, 4),
                               pension_ratio=rnd.randint(1, 4), expected_income=rnd.randint(1, 3),
                               pension_operator=rnd.choice([["A"], ["B", "A"], ["C"], ["A", "B", "C"], [], ["Z"]]),
                               direct_manage=rnd.choice([True, False, None])))
    return build_profiles(spark.createDataFrame(rows, SURVEY_DDL))


def user_candidates(pdf, ops, missing):
    o = pdf["operator_info"][pdf["operator_info"].operator_name.isin(ops)]
    m = pdf["product_mapping"][pdf["product_mapping"].operator_id.isin(o.id)]
    ids = sorted(set(m.product_id))
    i = pdf["product_info"][pdf["product_info"].id.isin(ids)]
    df = i.merge(pdf["product_fixed"], on="id", how="left").merge(pdf["product_variable"], on="id", how="left")
    df = df.rename(columns={"id": "product_id", "average_return_1y": "return_1y", "average_return_3y": "return_3y",
                            "average_return_5y": "return_5y"})
    for c in ["interest_rate", "return_1y", "return_3y", "return_5y", "total_expense_ratio", "total_net_worth", "maturity"]:
        df[c] = pd.to_numeric(df[c].astype(object), errors="coerce").astype(float)
    if missing == "zero":
        df["launch_date"] = df["launch_date"].where(df["launch_date"].notna(), pd.Timestamp(0))
        df = df.fillna(0)
    return df


def known(x):
    return x is not None and x == x


def ranked(scores, n):
    """(product, score) of the n best; unknown scores last; ties by product."""
    order = sorted(scores, key=lambda s: (not known(s[1]), -s[1] if known(s[1]) else 0.0, s[0]))
    return [(p, s if known(s) else float("nan")) for p, s in order[:n]]


def grnt_top(df, risk, n):
    """E1-E6 for one class: 0.7 x fit of the product's kind + 0.3 x weighted share of the best rate."""
    rates = [x for x in df.interest_rate if known(x)]
    best, scores = max(rates, default=0), []
    for p in df.to_dict("records"):
        fit = 0
        for words, table in ((K.SAFE_KEYWORDS, K.SAFE_FIT), (K.RISKY_KEYWORDS, K.RISKY_FIT)):  # risky has the last word
            fit = table.get(risk, 60) if any(w in p["product_name"] for w in words) else fit
        level = p["interest_rate"] / best * 100 if best and known(p["interest_rate"]) else None
        scores.append((p["product_id"], None if level is None else 0.7 * fit + 0.3 * (level * K.RATE_WEIGHT.get(risk, 0.8))))
    return ranked(scores, n)


def spans_of(rows, column):
    values = [r[column] for r in rows if known(r[column])]
    return (min(values), max(values)) if values else (None, None)


def var_top(df, risk, silver, manages_self, n):
    """F1-F12 for one segment, product by product."""
    rows = df.to_dict("records")
    spans = {c: spans_of(rows, c) for c in ("return_1y", "return_3y", "return_5y", "total_expense_ratio")}
    worths = sorted(r["total_net_worth"] for r in rows if known(r["total_net_worth"]))
    weights = K.WEIGHTS_SILVER if silver else K.WEIGHTS_NORMAL
    full, short = ((0.6, 0.2, 0.2), (0.75, 0.25)) if silver else ((0.2, 0.4, 0.4), (0.3, 0.7))
    matrix = K.RISK_LEVEL_MATRIX.get(risk, K.RISK_LEVEL_MATRIX[K.NEUTRAL])

    def share(row, column):
        lo, hi = spans[column]
        if lo == hi:
            return 50.0
        return 100 * (row[column] - lo) / (hi - lo) if known(row[column]) else None

    scores = []
    for row in rows:
        one, three, five = (share(row, c) for c in ("return_1y", "return_3y", "return_5y"))
        if one is None:
            ret = 0.0
        elif three is None:
            ret = one
        else:
            used = full if five is not None else short
            ret = sum((w * x for w, x in list(zip(used, (one, three, five)))[1:]), used[0] * one)
        digits = re.findall(r"\d+", str(row["risk_level"]))
        level = int(digits[0]) if digits else 6
        fit = matrix[level - 1] if 1 <= level <= len(matrix) else None
        lo, hi = spans["total_expense_ratio"]
        fee = 50.0 if lo == hi else 100 * (1 - (row["total_expense_ratio"] - lo) / (hi - lo)) if known(row["total_expense_ratio"]) else None
        if len(worths) <= 1:
            size = 50.0
        elif known(row["total_net_worth"]):
            below, upto = bisect.bisect_left(worths, row["total_net_worth"]), bisect.bisect_right(worths, row["total_net_worth"])
            size = 100 * ((below + 1 + upto) / 2 - 1) / (len(worths) - 1)
        else:
            size = 0.0
        age = 0
        if not pd.isna(row["launch_date"]):
            years = (pd.Timestamp(AS_OF) - pd.Timestamp(row["launch_date"])).days / 365.25
            age = max([points for limit, points in ((1, 20), (3, 40), (5, 60), (7, 80), (10, 100)) if years >= limit], default=0)
        target_date = str(row["eligible_tdf"]).strip().upper() == "O" or "TDF" in str(row["product_name"]).upper()
        parts = {"R": ret, "F": fit, "C": fee, "T": 100 if target_date and not manages_self else 0, "A": size, "S": age}
        total = None if None in parts.values() else sum((weights[k] * parts[k] for k in "FCTAS"), weights["R"] * parts["R"])
        scores.append((row["product_id"], total))
    return ranked(scores, n)


@pytest.mark.parametrize("missing", ["zero", "null"])
def test_portfolio_equals_per_user_restatement(spark, missing):
    cat, pdf = make_catalog(spark)
    prof = make_users(spark)
    sc = Scored(prof, cat, AS_OF, top_n=3, missing=missing)
    flat = portfolio_flat(recommend(sc)).toPandas()
    users = prof.toPandas()
    checked = 0
    for u in users.itertuples():
        df = user_candidates(pdf, list(u.pension_operator), missing)
        exp_g = grnt_top(df[df.category == "GUARANTEED"], u.risk_preference, 3)
        exp_v = var_top(df[df.category == "NON_GUARANTEED"], u.risk_preference, u.is_silver, u.manages_self, 3)
        got = flat[flat.user_id == u.user_id].sort_values(["half", "rank"])
        got_g = list(zip(got[got.half == "guaranteed"].product_id, got[got.half == "guaranteed"].score))
        got_v = list(zip(got[got.half == "non_guaranteed"].product_id, got[got.half == "non_guaranteed"].score))
        for exp, gt in ((exp_g, got_g), (exp_v, got_v)):
            assert [p for p, _ in exp] == [p for p, _ in gt], (u.user_id, exp, gt)
            for (_, a), (_, b) in zip(exp, gt):
                assert (pd.isna(a) and pd.isna(b)) or abs(round(a, 4) - b) < 1e-6
        checked += 1
    assert checked == 60


def test_empty_and_unknown_operators_give_empty_halves(spark):
    cat, _ = make_catalog(spark)
    prof = make_users(spark)
    p = recommend(Scored(prof, cat, AS_OF, top_n=3, materialize=False))
    rows = p.where("cand_key = '' OR cand_key = 'Z'").collect()
    assert rows and all(len(r.guaranteed) == 0 and len(r.non_guaranteed) == 0 for r in rows)


def test_silver_sentence_is_per_user(spark):
    cat, _ = make_catalog(spark)
    prof = make_users(spark)
    p = recommend(Scored(prof, cat, AS_OF, top_n=3, materialize=False)).collect()
    for r in p:
        for it in r.non_guaranteed:
            has = any("실버 모드" in s for s in it.reasons)
            assert has == bool(r.is_silver)
            if has:
                assert f"{r.period}년 이하" in it.reasons[-1]


def test_top3_derived_from_top5_equals_direct(spark):
    cat, _ = make_catalog(spark, seed=9)
    prof = make_users(spark)
    five = Scored(prof, cat, AS_OF, top_n=5)
    direct = portfolio_flat(recommend(Scored(prof, cat, AS_OF, top_n=3, hub=five.hub))).collect()
    derived = portfolio_flat(recommend(Scored(prof, top_n=3, base=five))).collect()
    key = lambda r: (r.user_id, r.half, r.rank)
    assert sorted(map(tuple, direct), key=repr) == sorted(map(tuple, derived), key=repr)
    assert max(r.rank for r in derived) == 3 and len(direct) == len(derived) and key


def test_shuffle_fallback_equals_broadcast_plan(spark, monkeypatch):
    """With a tiny broadcast budget every size-checked join falls back to a shuffle join: same result."""
    import nestegg.session as S
    cat, _ = make_catalog(spark, seed=5)
    prof = make_users(spark)
    base = sorted(map(tuple, portfolio_flat(recommend(Scored(prof, cat, AS_OF, top_n=3, materialize=False))).collect()),
                  key=repr)
    monkeypatch.setattr(S, "BROADCAST_MAX_BYTES", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fb = recommend(Scored(prof, cat, AS_OF, top_n=3, materialize=False))
        plan = fb._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, portfolio_flat(fb).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert got == base


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_topn_is_exact_under_rounding_ties(spark, seed):
    """Totals that are equal but for rounding: the order is that of the exact doubles over all rows."""
    from pyspark.sql import functions as F
    from nestegg.operators.variable import score_segments, variable_topn
    rnd = random.Random(seed)
    rows = []
    for i in range(101):
        c, a = rnd.choice([(x / 10, (900 - 15 * x / 10) / 8) for x in range(0, 600, 7)])
        rows.append(("k", f"p{rnd.randrange(10**6):06d}-{i}", 50.0, 50.0, c, a, 0.0, rnd.choice([2, 3, 9]), rnd.randrange(2)))
    comp = spark.createDataFrame(rows, "cand_key string, product_id string, score_r double, score_r_silver double, "
                                       "score_c double, score_a double, score_s double, parsed_risk long, product_tdf int")
    segs = spark.createDataFrame([("k", r, s, m) for r in [*K.RISK_LEVEL_MATRIX, "other"] for s in (True, False) for m in (True, False)],
                                 "cand_key string, risk_preference string, is_silver boolean, manages_self boolean")
    keys = ["risk_preference", "is_silver", "manages_self"]
    got = {}
    for r in variable_topn(comp, segs, 3).collect():
        got.setdefault(tuple(r[k] for k in keys), []).append((r["rank"], r.product_id))
    everything = {}
    for r in score_segments(comp.join(F.broadcast(segs), "cand_key")).collect():
        everything.setdefault(tuple(r[k] for k in keys), []).append((r.total_score, r.product_id))
    for seg, scored in everything.items():
        best = sorted(scored, key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))[:3]
        assert sorted(got[seg]) == [(i + 1, p) for i, (_, p) in enumerate(best)], seg


def test_candidate_keys_never_collide(spark):
    from nestegg.functions.profile import candidate_key
    lists = [["A", "B"], ["A|B"], ["A\\", "B"], ["A\\|B"], ["B", "A", "A"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ops array<string>")
    keys = {r.i: r.k for r in df.select("i", candidate_key(df.ops).alias("k")).collect()}
    assert keys[0] == keys[4] == "A|B" and len(set(keys.values())) == 4
