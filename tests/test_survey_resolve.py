"""B1-B3 survey normalisation and steps; C1-C3 operator resolution against difflib."""

import difflib
import random

from nestegg import constants as K
from nestegg.operators.resolve import resolve_operators
from nestegg.operators.survey import answer_texts, normalize_answers, survey_next_step, survey_options


def test_normalize_answers(spark):
    raw = [(1, "age", " 41 "), (1, "period", "7"), (1, "experience", "3. 펀드"), (1, "loss_level", "4. x"),
           (1, "investment_amount", "250"), (1, "pension_operator", "KB증권,iM증권"),
           (1, "direct_manage", "1. 내가 직접 관리"), (2, "direct_manage", "2. 전문가에게 맡김"), (2, "age", "abc")]
    df = spark.createDataFrame(raw, "user_id long, step_key string, answer string")
    got = {r.user_id: r for r in normalize_answers(df).collect()}
    r = got[1]
    assert (r.age, r.period, r.experience, r.loss_level, r.investment_amount) == (41, 7, 3, 4, 2500000)
    assert r.pension_operator == ["KB증권", "iM증권"] and r.direct_manage is True
    assert got[2].direct_manage is False and got[2].age is None and got[2].psychology is None


def test_next_step(spark):
    keys = K.SURVEY_KEYS
    rows = []
    for answered in range(len(keys) + 1):
        vals = [1 if i < answered else None for i in range(len(keys))]
        rows.append(tuple([answered] + vals))
    ddl = "user_id long, " + ", ".join(f"{k} int" for k in keys)
    got = {r.user_id: r for r in survey_next_step(spark.createDataFrame(rows, ddl)).collect()}
    for answered in range(len(keys)):
        r = got[answered]
        assert r.next_step == keys[answered] and r.step_no == answered + 1 and not r.done
        label = dict((k, lbl) for k, lbl, _ in K.SURVEY_STEPS)[keys[answered]] or K.SURVEY_QUESTIONS[keys[answered]][0]
        assert r.step_label == label
        assert r.is_last_step == (answered == len(keys) - 1)
    assert got[len(keys)].done and got[len(keys)].next_step is None


def test_options_and_texts(spark):
    opts = survey_options(spark)
    assert opts.count() == 30
    ans = spark.createDataFrame([(1, 2, 1, 3, 1, 2, 4, 1)], "user_id long, experience int, psychology int, loss_level int, "
                                "finance_knowledge int, investment_goal int, pension_ratio int, expected_income int")
    got = {r.step_key: r.option_text for r in answer_texts(ans, opts).collect()}
    assert got["experience"].startswith("2.") and got["pension_ratio"] == "4. 70% 이상"


def test_resolution_matches_difflib(spark):
    names = ["DB생명보험", "DB손해보험", "삼성증권", "삼성생명보험", "한국투자증권", "미래에셋증권", "KB증권", "iM증권",
             "하나은행", "신한투자증권", "한화투자증권", "NH투자증권"]
    rnd = random.Random(5)
    typed = ["   ", "", "삼성증권", "  KB증권 ", "qqqq", "zzzzzzzzzz"]
    for _ in range(120):
        n = rnd.choice(names)
        op = rnd.choice(["drop", "dup", "swap", "sub"])
        i = rnd.randrange(len(n))
        t = {"drop": n[:i] + n[i + 1:], "dup": n[:i] + n[i] + n[i:], "swap": n[::-1],
             "sub": n[:i] + rnd.choice("가나다x증권") + n[i + 1:]}[op]
        typed.append(t)
    users = spark.createDataFrame(list(enumerate(typed)), "user_id long, typed string")
    dim = spark.createDataFrame([(n,) for n in names], "operator_name string")
    got = {r.user_id: r for r in resolve_operators(users, dim).collect()}
    for uid, t in enumerate(typed):
        target = t.strip()
        r = got[uid]
        if not target:
            assert r.outcome == "blank"
        elif target in names:
            assert r.outcome == "exact" and r.matched == target
        else:
            exp = difflib.get_close_matches(target, names, n=3, cutoff=0.4)
            if exp:
                assert r.outcome == "suggest" and list(r.suggestions) == exp, (t, exp, r.suggestions)
            else:
                assert r.outcome == "none" and r.suggestions is None
