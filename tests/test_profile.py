"""Risk score, class, allocation and segment flags against a plain-Python restatement."""

import random

from conftest import SURVEY_DDL, survey_row

from nestegg.operators.survey import build_profiles


def py_score(a):
    s = 0
    age = a["age"]
    s += 10 if 19 <= age <= 34 else 8 if 35 <= age <= 44 else 6 if 45 <= age <= 54 else 4 if 55 <= age <= 64 else 2
    p = a["period"]
    s += 15 if p >= 10 else 12 if p >= 5 else 8 if p >= 3 else 4 if p >= 1 else 2
    s += {1: 15, 2: 12, 3: 9, 4: 6, 5: 3}.get(a["experience"], 1)
    s += {1: 10, 2: 5}.get(a["psychology"], 1)
    s += {2: 8, 3: 14, 4: 20}.get(a["loss_level"], 0)
    s += {1: 10, 2: 7, 3: 4}.get(a["finance_knowledge"], 1)
    s += {1: 5, 2: 4, 3: 2, 4: 1}.get(a["investment_goal"], 0)
    s += {1: 10, 2: 7, 3: 4}.get(a["pension_ratio"], 1)
    s += {1: 5, 2: 3}.get(a["expected_income"], 1)
    return s


def py_class(a):
    if a["loss_level"] == 1:
        return "안정형"
    s = py_score(a)
    if s <= 30:
        return "안정형"
    if s <= 50:
        return "안정추구형"
    if s <= 70:
        return "위험중립형"
    if a["loss_level"] == 2:
        return "위험중립형"
    return "적극투자형" if s <= 90 else "공격투자형"


def test_random_profiles_match_restatement(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        rows.append(survey_row(i, age=rnd.randint(10, 80), period=rnd.randint(0, 20), experience=rnd.randint(1, 7),
                               psychology=rnd.randint(1, 3), loss_level=rnd.randint(1, 4),
                               finance_knowledge=rnd.randint(1, 5), investment_goal=rnd.randint(1, 5),
                               pension_ratio=rnd.randint(1, 4), expected_income=rnd.randint(1, 3),
                               direct_manage=rnd.choice([True, False, None])))
    df = spark.createDataFrame(rows, SURVEY_DDL)
    got = {r.user_id: r for r in build_profiles(df).collect()}
    share = {"안정형": .85, "안정추구형": .75, "위험중립형": .60, "적극투자형": .45, "공격투자형": .30}
    for a in rows:
        g = got[a["user_id"]]
        assert g.risk_score == py_score(a)
        assert g.risk_preference == py_class(a)
        assert g.grnt_ratio == share[py_class(a)]
        assert g.is_silver == (a["period"] <= 5)
        assert g.manages_self == bool(a["direct_manage"])


def test_class_edges(spark):
    # Base answers give 2+15+... ; tune age/period to hit each edge exactly.
    base = dict(experience=6, psychology=3, loss_level=3, finance_knowledge=4, investment_goal=5, pension_ratio=4,
                expected_income=3)  # 1+1+14+1+0+1+1 = 19
    rows = [survey_row(1, age=70, period=0, **base),                     # 2+2+19 = 23
            survey_row(2, age=25, period=12, **base)]                    # 10+15+19 = 44
    hi = dict(experience=1, psychology=1, finance_knowledge=1, investment_goal=1, pension_ratio=1, expected_income=1)
    rows += [survey_row(3, age=25, period=12, loss_level=4, **hi),       # 100 -> aggressive
             survey_row(4, age=25, period=12, loss_level=1, **hi),       # loss 1 -> stable regardless
             survey_row(5, age=25, period=12, loss_level=2, **hi)]       # 88, capped to neutral
    got = {r.user_id: (r.risk_score, r.risk_preference) for r in build_profiles(spark.createDataFrame(rows, SURVEY_DDL)).collect()}
    assert got[1] == (23, "안정형")
    assert got[2] == (44, "안정추구형")
    assert got[3] == (100, "공격투자형")
    assert got[4][1] == "안정형"
    assert got[5] == (88, "위험중립형")


def test_silver_boundary_and_defaults(spark):
    rows = [survey_row(1, period=5), survey_row(2, period=6), survey_row(3, period=None)]
    got = {r.user_id: r.is_silver for r in build_profiles(spark.createDataFrame(rows, SURVEY_DDL)).collect()}
    assert got == {1: True, 2: False, 3: False}
    # Absent optional columns take the defaults.
    df = spark.createDataFrame([survey_row(1)], SURVEY_DDL).drop("investment_amount", "direct_manage", "period")
    r = build_profiles(df).first()
    assert (r.investment_amount, r.direct_manage, r.period, r.is_silver) == (0, True, 10, False)


def test_candidate_key_is_order_free(spark):
    rows = [survey_row(1, pension_operator=["B", "A", "B"]), survey_row(2, pension_operator=["A", "B"]),
            survey_row(3, pension_operator=[])]
    got = {r.user_id: r.cand_key for r in build_profiles(spark.createDataFrame(rows, SURVEY_DDL)).collect()}
    assert got[1] == got[2] == "A|B"
    assert got[3] == ""
