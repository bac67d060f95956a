"""Independent DuckDB oracle SQL for the registered queries.

The oracle is written the brute-force way the reference computes: every product
of a candidate set is scored for every segment and then sorted; no pooling, no
bucketed ranks. Fixture tables come in as CTEs (``sources.fixtures``). Weights are
cast to DOUBLE so that DuckDB does the same IEEE arithmetic as the Spark side
(an unadorned ``0.7`` is a DECIMAL in DuckDB).
"""

from __future__ import annotations

from nestegg import constants as K
from nestegg.sources.fixtures import DIRTY_NAMES, INTEGRITY_NAMES, oracle_ctes

AS_OF = "2026-01-01"
TOP_N = 3
CHAT_TOP_N = 5


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _case_map(col: str, mapping: dict, default, fmt=_q) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {fmt(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {fmt(default)} END"


def _like_any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"coalesce(contains({col}, {_q(w)}), false)" for w in words) + ")"


PROFILE = f"""
prof0 AS (
  SELECT s.*,
    CAST((CASE WHEN age BETWEEN 19 AND 34 THEN 10 WHEN age BETWEEN 35 AND 44 THEN 8
               WHEN age BETWEEN 45 AND 54 THEN 6 WHEN age BETWEEN 55 AND 64 THEN 4 ELSE 2 END)
    + (CASE WHEN period >= 10 THEN 15 WHEN period >= 5 THEN 12 WHEN period >= 3 THEN 8 WHEN period >= 1 THEN 4 ELSE 2 END)
    + (CASE experience WHEN 1 THEN 15 WHEN 2 THEN 12 WHEN 3 THEN 9 WHEN 4 THEN 6 WHEN 5 THEN 3 ELSE 1 END)
    + (CASE psychology WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 1 END)
    + (CASE loss_level WHEN 2 THEN 8 WHEN 3 THEN 14 WHEN 4 THEN 20 ELSE 0 END)
    + (CASE finance_knowledge WHEN 1 THEN 10 WHEN 2 THEN 7 WHEN 3 THEN 4 ELSE 1 END)
    + (CASE investment_goal WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END)
    + (CASE pension_ratio WHEN 1 THEN 10 WHEN 2 THEN 7 WHEN 3 THEN 4 ELSE 1 END)
    + (CASE expected_income WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 1 END) AS INTEGER) AS risk_score
  FROM fx_survey s
),
prof1 AS (
  SELECT *,
    CASE WHEN loss_level = 1 THEN '안정형' WHEN risk_score <= 30 THEN '안정형'
         WHEN risk_score <= 50 THEN '안정추구형' WHEN risk_score <= 70 THEN '위험중립형'
         WHEN loss_level = 2 THEN '위험중립형' WHEN risk_score <= 90 THEN '적극투자형'
         ELSE '공격투자형' END AS risk_preference,
    coalesce(period <= 5, false) AS is_silver,
    coalesce(direct_manage, false) AS manages_self,
    array_to_string(list_sort(list_distinct(pension_operator)), '|') AS cand_key
  FROM prof0
),
prof AS (
  SELECT *, {_case_map('risk_preference', K.GUARANTEED_SHARE, K.GUARANTEED_SHARE_DEFAULT, _d)} AS grnt_ratio
  FROM prof1
)"""

CANDIDATES = """
cset AS (
  SELECT DISTINCT cand_key, unnest(pension_operator) AS operator_name FROM prof
  WHERE cand_key IS NOT NULL AND cand_key <> ''
),
cands0 AS (
  SELECT DISTINCT c.cand_key, i.id AS product_id, i.product_name, i.product_type, i.category,
         f.maturity, f.interest_rate, v.risk_level, v.eligible_tdf, v.launch_date, v.total_net_worth,
         v.total_expense_ratio, v.average_return_1y AS return_1y, v.average_return_3y AS return_3y,
         v.average_return_5y AS return_5y
  FROM fx_product_info i
  JOIN fx_product_mapping m ON i.id = m.product_id
  JOIN fx_operator_info o ON m.operator_id = o.id
  JOIN cset c ON o.operator_name = c.operator_name
  LEFT JOIN fx_product_fixed f ON i.id = f.id
  LEFT JOIN fx_product_variable v ON i.id = v.id
),
cands AS (
  SELECT cand_key, product_id, product_name, coalesce(product_type, '0') AS product_type, category,
         coalesce(CAST(maturity AS DOUBLE), 0.0) AS maturity,
         coalesce(CAST(interest_rate AS DOUBLE), 0.0) AS interest_rate,
         coalesce(risk_level, '0') AS risk_level, coalesce(eligible_tdf, '0') AS eligible_tdf,
         launch_date,
         coalesce(CAST(total_net_worth AS DOUBLE), 0.0) AS total_net_worth,
         coalesce(CAST(total_expense_ratio AS DOUBLE), 0.0) AS total_expense_ratio,
         coalesce(CAST(return_1y AS DOUBLE), 0.0) AS return_1y,
         coalesce(CAST(return_3y AS DOUBLE), 0.0) AS return_3y,
         coalesce(CAST(return_5y AS DOUBLE), 0.0) AS return_5y
  FROM cands0
)"""

# Missing values kept: the same rows without the fill.
CANDIDATES_NULL = CANDIDATES[: CANDIDATES.index("cands AS (")] + """cands AS (
  SELECT * REPLACE (CAST(maturity AS DOUBLE) AS maturity, CAST(interest_rate AS DOUBLE) AS interest_rate,
    CAST(total_net_worth AS DOUBLE) AS total_net_worth, CAST(total_expense_ratio AS DOUBLE) AS total_expense_ratio,
    CAST(return_1y AS DOUBLE) AS return_1y, CAST(return_3y AS DOUBLE) AS return_3y, CAST(return_5y AS DOUBLE) AS return_5y)
  FROM cands0
)"""

_SAFE = _like_any("product_name", K.SAFE_KEYWORDS)
_RISKY = _like_any("product_name", K.RISKY_KEYWORDS)

GUARANTEED = f"""
gstat AS (SELECT cand_key, max(interest_rate) AS max_rate FROM cands WHERE category = 'GUARANTEED' GROUP BY cand_key),
gcomp AS (
  SELECT c.*, {_SAFE} AS is_safe, {_RISKY} AS is_risky,
         (CASE WHEN s.max_rate = 0 THEN NULL ELSE c.interest_rate / s.max_rate END) * CAST(100.0 AS DOUBLE) AS rate_level
  FROM cands c JOIN gstat s USING (cand_key) WHERE c.category = 'GUARANTEED'
),
gseg AS (SELECT DISTINCT cand_key, risk_preference FROM prof WHERE cand_key IS NOT NULL),
gscore0 AS (
  SELECT g.*, s.risk_preference,
    CASE WHEN is_risky THEN {_case_map('s.risk_preference', K.RISKY_FIT, K.FIT_DEFAULT, str)}
         WHEN is_safe THEN {_case_map('s.risk_preference', K.SAFE_FIT, K.FIT_DEFAULT, str)}
         ELSE 0 END AS product_score,
    rate_level * {_case_map('s.risk_preference', K.RATE_WEIGHT, K.RATE_WEIGHT_DEFAULT, _d)} AS rate_score
  FROM gcomp g JOIN gseg s USING (cand_key)
),
gscore AS (
  SELECT *, {_d(K.GUARANTEED_FIT_WEIGHT)} * CAST(product_score AS DOUBLE) + {_d(K.GUARANTEED_RATE_WEIGHT)} * rate_score AS score
  FROM gscore0
),
gtop AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY cand_key, risk_preference
                                 ORDER BY score DESC NULLS LAST, product_id) AS rank
    FROM gscore) WHERE rank <= {TOP_N}
),
greason AS (
  SELECT *, concat_ws(' | ',
    CASE WHEN is_risky THEN {_case_map('risk_preference', {K.STABLE: K.FIT_OFF, K.STABLE_SEEKING: K.FIT_PARTLY_OFF, K.NEUTRAL: K.FIT_PARTLY, K.ACTIVE: K.FIT_MOSTLY}, K.FIT_MATCH)}
         WHEN is_safe THEN {_case_map('risk_preference', {K.STABLE: K.FIT_MATCH, K.STABLE_SEEKING: K.FIT_MOSTLY, K.NEUTRAL: K.FIT_PARTLY, K.ACTIVE: K.FIT_PARTLY_OFF}, K.FIT_OFF)}
    END,
    replace({_case_map('risk_preference', K.RATE_TEMPLATES, K.RATE_TEMPLATE_OTHER)}, '%s',
            CASE WHEN rate_level >= 80 THEN {_q(K.RATE_HIGH)} WHEN rate_level >= 50 THEN {_q(K.RATE_MID)}
                 ELSE {_q(K.RATE_LOW)} END)
  ) AS reasons
  FROM gtop
)"""


def _rmix(w3, w2):
    return (f"CASE WHEN norm_1y IS NULL THEN CAST(0.0 AS DOUBLE) "
            f"WHEN norm_3y IS NOT NULL AND norm_5y IS NOT NULL THEN {_d(w3[0])} * norm_1y + {_d(w3[1])} * norm_3y + {_d(w3[2])} * norm_5y "
            f"WHEN norm_3y IS NOT NULL THEN {_d(w2[0])} * norm_1y + {_d(w2[1])} * norm_3y "
            f"ELSE CAST(1.0 AS DOUBLE) * norm_1y END")


def _norm(col, lo, hi):
    return (f"CASE WHEN {hi} = {lo} THEN CAST(50.0 AS DOUBLE) "
            f"ELSE CAST(100.0 AS DOUBLE) * ({col} - {lo}) / ({hi} - {lo}) END")


_MATRIX = " ".join(f"WHEN {_q(k)} THEN {list(v)}" for k, v in K.RISK_LEVEL_MATRIX.items())


def _total(w):
    return (f"{_d(w['R'])} * score_r_mode + {_d(w['F'])} * score_f + {_d(w['C'])} * score_c "
            f"+ {_d(w['T'])} * score_t + {_d(w['A'])} * score_a + {_d(w['S'])} * score_s")


VARIABLE = f"""
vstat AS (
  SELECT cand_key, min(return_1y) AS mn1, max(return_1y) AS mx1, min(return_3y) AS mn3, max(return_3y) AS mx3,
         min(return_5y) AS mn5, max(return_5y) AS mx5, min(total_expense_ratio) AS mnf,
         max(total_expense_ratio) AS mxf, count(total_net_worth) AS n_worth
  FROM cands WHERE category = 'NON_GUARANTEED' GROUP BY cand_key
),
vc0 AS (
  SELECT c.*, s.n_worth,
    {_norm('return_1y', 'mn1', 'mx1')} AS norm_1y,
    {_norm('return_3y', 'mn3', 'mx3')} AS norm_3y,
    {_norm('return_5y', 'mn5', 'mx5')} AS norm_5y,
    CASE WHEN mxf = mnf THEN CAST(50.0 AS DOUBLE)
         ELSE CAST(100.0 AS DOUBLE) * (CAST(1.0 AS DOUBLE) - (total_expense_ratio - mnf) / (mxf - mnf)) END AS score_c,
    CASE WHEN total_net_worth IS NULL THEN NULL ELSE
      CAST(rank() OVER (PARTITION BY cand_key ORDER BY total_net_worth NULLS LAST) AS DOUBLE)
      + (count(*) OVER (PARTITION BY cand_key, total_net_worth) + 1) / 2.0 - 1 END AS worth_rank,
    CASE WHEN regexp_extract(coalesce(risk_level, 'None'), '[0-9]+', 0) = '' THEN 6
         ELSE coalesce(TRY_CAST(regexp_extract(coalesce(risk_level, 'None'), '[0-9]+', 0) AS BIGINT), -1) END AS parsed_risk,
    CASE WHEN upper(trim(coalesce(eligible_tdf, 'None'))) = 'O' OR coalesce(contains(upper(product_name), 'TDF'), false)
         THEN 1 ELSE 0 END AS product_tdf,
    CAST(date_diff('day', coalesce(launch_date, DATE '1970-01-01'), DATE '{AS_OF}') AS DOUBLE) / CAST(365.25 AS DOUBLE) AS years_active
  FROM cands c JOIN vstat s USING (cand_key) WHERE c.category = 'NON_GUARANTEED'
),
vcomp AS (
  SELECT *,
    {_rmix(K.RETURN_WEIGHTS_NORMAL, K.RETURN_WEIGHTS_NORMAL_NO5)} AS score_r,
    {_rmix(K.RETURN_WEIGHTS_SILVER, K.RETURN_WEIGHTS_SILVER_NO5)} AS score_r_silver,
    CASE WHEN n_worth > 1 THEN coalesce(CAST(100.0 AS DOUBLE) * (worth_rank - 1) / (n_worth - 1), CAST(0.0 AS DOUBLE))
         ELSE CAST(50.0 AS DOUBLE) END AS score_a,
    CAST(CASE WHEN years_active IS NULL THEN 0 WHEN years_active >= 10 THEN 100 WHEN years_active >= 7 THEN 80
         WHEN years_active >= 5 THEN 60 WHEN years_active >= 3 THEN 40 WHEN years_active >= 1 THEN 20 ELSE 0 END AS DOUBLE) AS score_s
  FROM vc0
),
vseg AS (SELECT DISTINCT cand_key, risk_preference, is_silver, manages_self FROM prof WHERE cand_key IS NOT NULL),
vscore0 AS (
  SELECT v.*, s.risk_preference, s.is_silver, s.manages_self,
    CASE WHEN s.is_silver THEN score_r_silver ELSE score_r END AS score_r_mode,
    CASE WHEN parsed_risk BETWEEN 1 AND 6 THEN
      CAST((CASE s.risk_preference {_MATRIX} ELSE {list(K.RISK_LEVEL_MATRIX[K.NEUTRAL])} END)[parsed_risk] AS DOUBLE)
    END AS score_f,
    CAST(product_tdf * (CASE WHEN s.manages_self THEN 0 ELSE 100 END) AS DOUBLE) AS score_t
  FROM vcomp v JOIN vseg s USING (cand_key)
),
vscore AS (
  SELECT *, CASE WHEN is_silver THEN {_total(K.WEIGHTS_SILVER)} ELSE {_total(K.WEIGHTS_NORMAL)} END AS total_score
  FROM vscore0
),
vtop AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY cand_key, risk_preference, is_silver, manages_self
                                 ORDER BY total_score DESC NULLS LAST, product_id) AS rank
    FROM vscore) WHERE rank <= {TOP_N}
),
vreason AS (
  SELECT *, concat_ws(' | ',
    CASE WHEN score_f = 100 THEN replace(replace({_q(K.VR_F_EXACT)}, '''%s''', '''' || risk_preference || ''''), '(%s', '(' || CAST(parsed_risk AS VARCHAR))
         WHEN score_f >= 60 THEN replace({_q(K.VR_F_BROAD)}, '%s', risk_preference)
         WHEN score_f > 0 THEN {_q(K.VR_F_SOME)} END,
    CASE WHEN score_r_mode >= 80 THEN {_q(K.VR_R_TOP)} WHEN score_r_mode >= 50 THEN {_q(K.VR_R_GOOD)} ELSE {_q(K.VR_R_OTHER)} END,
    CASE WHEN score_c >= 80 THEN {_q(K.VR_C_LOW)} WHEN score_c >= 50 THEN {_q(K.VR_C_FAIR)} END,
    CASE WHEN score_t > 0 AND NOT manages_self THEN {_q(K.VR_TDF)} END,
    CASE WHEN score_a >= 70 AND score_s >= 60 THEN {_q(K.VR_SIZE_AGE)} END
  ) AS reasons
  FROM vtop
)"""


def _with(fixtures: list[str], *blocks: str) -> str:
    return "WITH " + ",\n".join([oracle_ctes(fixtures), *[b.strip() for b in blocks]]) + "\n"


_CATALOG_FX = ["fx_survey", "fx_operator_info", "fx_product_info", "fx_product_fixed", "fx_product_variable",
               "fx_product_mapping"]


def _scoring_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["risk_profile"] = _with(["fx_survey"], PROFILE) + """
SELECT user_id, risk_score, risk_preference, grnt_ratio, is_silver, manages_self, cand_key FROM prof"""

    q["candidates"] = _with(_CATALOG_FX, PROFILE, CANDIDATES) + """
SELECT cand_key, product_id, product_name, product_type, category, maturity, interest_rate, risk_level,
       eligible_tdf, CAST(launch_date AS VARCHAR) AS launch_date, total_net_worth, total_expense_ratio,
       return_1y, return_3y, return_5y
FROM cands"""

    q["guaranteed_scores"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, GUARANTEED) + """
SELECT cand_key, risk_preference, product_id, is_safe, is_risky, product_score,
       round(rate_level, 6) AS rate_level, round(rate_score, 6) AS rate_score, round(score, 6) AS score
FROM gscore"""

    q["guaranteed_topn"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, GUARANTEED) + """
SELECT cand_key, risk_preference, CAST(rank AS INTEGER) AS rank, product_id, round(score, 6) AS score FROM gtop"""

    q["guaranteed_reasons"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, GUARANTEED) + """
SELECT cand_key, risk_preference, CAST(rank AS INTEGER) AS rank, product_id, reasons FROM greason"""

    q["variable_return_score"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, VARIABLE) + """
SELECT cand_key, product_id, round(norm_1y, 6) AS norm_1y, round(norm_3y, 6) AS norm_3y, round(norm_5y, 6) AS norm_5y,
       round(score_r, 6) AS score_r, round(score_r_silver, 6) AS score_r_silver
FROM vcomp"""

    q["variable_risk_score"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, VARIABLE) + """
SELECT DISTINCT cand_key, risk_preference, product_id, parsed_risk, score_f FROM vscore0"""

    q["variable_tdf_score"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, VARIABLE) + """
SELECT DISTINCT cand_key, manages_self, product_id, product_tdf, score_t FROM vscore0"""

    q["variable_fee_score"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, VARIABLE) + """
SELECT cand_key, product_id, total_expense_ratio, round(score_c, 6) AS score_c FROM vcomp"""

    q["variable_size_score"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, VARIABLE) + """
SELECT cand_key, product_id, total_net_worth, round(score_a, 6) AS score_a FROM vcomp"""

    q["variable_age_score"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, VARIABLE) + """
SELECT cand_key, product_id, round(years_active, 6) AS years_active, score_s FROM vcomp"""

    q["variable_total_topn"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, VARIABLE) + """
SELECT cand_key, risk_preference, is_silver, manages_self, CAST(rank AS INTEGER) AS rank, product_id,
       round(total_score, 6) AS total_score
FROM vtop"""

    q["variable_reasons"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, VARIABLE) + """
SELECT cand_key, risk_preference, is_silver, manages_self, CAST(rank AS INTEGER) AS rank, product_id, reasons
FROM vreason"""

    null_variable = VARIABLE.replace("coalesce(launch_date, DATE '1970-01-01')", "launch_date")
    nulls = _with(_CATALOG_FX, PROFILE, CANDIDATES_NULL, GUARANTEED, null_variable)
    q["null_return_score"] = nulls + """
SELECT cand_key, product_id, round(norm_1y, 6) AS norm_1y, round(norm_3y, 6) AS norm_3y, round(norm_5y, 6) AS norm_5y,
       round(score_r, 6) AS score_r, round(score_r_silver, 6) AS score_r_silver
FROM vcomp"""
    q["null_size_age_score"] = nulls + """
SELECT cand_key, product_id, total_net_worth, round(score_a, 6) AS score_a, round(years_active, 6) AS years_active, score_s FROM vcomp"""
    q["null_total_topn"] = nulls + """
SELECT cand_key, risk_preference, is_silver, manages_self, CAST(rank AS INTEGER) AS rank, product_id,
       round(total_score, 6) AS total_score
FROM vtop"""
    q["null_guaranteed_topn"] = nulls + """
SELECT cand_key, risk_preference, CAST(rank AS INTEGER) AS rank, product_id, round(score, 6) AS score FROM gtop"""

    q["latest_portfolio"] = _with(["fx_survey"], PROFILE) + """
SELECT user_id, max(turn) AS turn, any_value(risk_preference) AS risk_preference,
       CAST(any_value(coalesce(investment_amount, 0)) + max(turn) AS BIGINT) AS amount
FROM prof JOIN conversations c ON c.conv_id = user_id WHERE role = 'user' GROUP BY user_id"""

    silver = _q(K.VR_SILVER)
    q["portfolio_flat"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, GUARANTEED, VARIABLE) + f"""
SELECT p.user_id, 'guaranteed' AS half, CAST(g.rank AS INTEGER) AS rank, g.product_id, g.product_name,
       CAST(format('{{:.1f}}', g.score) AS DOUBLE) AS display_score, round(g.score, 4) AS score, g.reasons
FROM prof p JOIN greason g ON p.cand_key = g.cand_key AND p.risk_preference = g.risk_preference
UNION ALL
SELECT p.user_id, 'non_guaranteed' AS half, CAST(v.rank AS INTEGER) AS rank, v.product_id, v.product_name,
       CAST(format('{{:.1f}}', v.total_score) AS DOUBLE) AS display_score, round(v.total_score, 4) AS score,
       CASE WHEN p.is_silver THEN concat_ws(' | ', v.reasons, replace({silver}, '%s', CAST(p.period AS VARCHAR)))
            ELSE v.reasons END AS reasons
FROM prof p JOIN vreason v ON p.cand_key = v.cand_key AND p.risk_preference = v.risk_preference
  AND p.is_silver = v.is_silver AND p.manages_self = v.manages_self"""

    q["portfolio_summary"] = _with(_CATALOG_FX, PROFILE, CANDIDATES, GUARANTEED, VARIABLE) + """
SELECT p.user_id, p.risk_preference, CAST(coalesce(p.investment_amount, 0) AS BIGINT) AS total_amt,
       p.grnt_ratio, round(CAST(1.0 AS DOUBLE) - p.grnt_ratio, 6) AS ungrnt_ratio,
       CAST((SELECT count(*) FROM gtop g WHERE g.cand_key = p.cand_key AND g.risk_preference = p.risk_preference) AS BIGINT) AS n_guaranteed,
       CAST((SELECT count(*) FROM vtop v WHERE v.cand_key = p.cand_key AND v.risk_preference = p.risk_preference
              AND v.is_silver = p.is_silver AND v.manages_self = p.manages_self) AS BIGINT) AS n_non_guaranteed
FROM prof p"""
    return q


def _survey_sql() -> dict[str, str]:
    q = {}
    keys = K.SURVEY_KEYS
    nxt = "CASE " + " ".join(f"WHEN {k} IS NULL THEN {_q(k)}" for k in keys) + " END"
    labels = {k: (lbl or K.SURVEY_QUESTIONS[k][0]) for k, lbl, _ in K.SURVEY_STEPS}
    q["survey_next_step"] = _with(["fx_survey_partial"]) + f"""
SELECT user_id, next_step,
       CAST(CASE next_step {' '.join(f"WHEN {_q(k)} THEN {i + 1}" for i, k in enumerate(keys))} END AS INTEGER) AS step_no,
       CASE next_step {' '.join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in labels.items())} END AS step_label,
       next_step IS NULL AS done,
       coalesce(next_step = {_q(keys[-1])}, false) AS is_last_step
FROM (SELECT user_id, {nxt} AS next_step FROM fx_survey_partial) t"""

    cols = []
    for k, _, kind in K.SURVEY_STEPS:
        a = f"max(CASE WHEN step_key = {_q(k)} THEN answer END)"
        if k == "investment_amount":
            cols.append(f"TRY_CAST(trim({a}) AS BIGINT) * {K.AMOUNT_UNIT} AS {k}")
        elif kind == "number":
            cols.append(f"TRY_CAST(trim({a}) AS INTEGER) AS {k}")
        elif k == "direct_manage":
            cols.append(f"starts_with({a}, '1') AS {k}")
        elif k == "pension_operator":
            cols.append(f"{a} AS {k}")
        else:
            cols.append(f"TRY_CAST(substr({a}, 1, 1) AS INTEGER) AS {k}")
    q["normalize_answers"] = _with(["fx_raw_answers"]) + (
        "SELECT user_id, " + ", ".join(cols) + " FROM fx_raw_answers GROUP BY user_id")

    radio = [k for k, _, kind in K.SURVEY_STEPS if kind == "radio" and k != "direct_manage"]
    unp = " UNION ALL ".join([f"SELECT user_id, {_q(k)} AS step_key, CAST({k} AS INTEGER) AS option_code FROM fx_survey"
                              for k in radio]
                             + ["SELECT user_id, 'direct_manage', CASE direct_manage WHEN true THEN 1 WHEN false THEN 2 END FROM fx_survey"])
    opts = ", ".join(f"({_q(k)}, {int(o[0])}, {_q(o)}, {_q(lbl)})" for k, (lbl, os_) in K.SURVEY_QUESTIONS.items() for o in os_)
    q["survey_answer_text"] = _with(["fx_survey"]) + f"""
SELECT a.user_id, a.step_key, a.option_code, o.option_text, o.label
FROM ({unp}) a LEFT JOIN (VALUES {opts}) AS o(step_key, option_code, option_text, label)
  ON a.step_key = o.step_key AND a.option_code = o.option_code"""
    return q


def _integrity_sql(tables: dict[str, str]) -> str:
    from nestegg import schemas
    parts = []
    for t, fx in tables.items():
        pk = schemas.PRIMARY_KEYS[t]
        parts.append(f"SELECT {_q(t)} AS table_name, 'primary_key' AS rule, {_q(','.join(pk))} AS column_name, "
                     f"(SELECT count(*) FROM (SELECT {', '.join(pk)} FROM {fx} GROUP BY {', '.join(pk)} "
                     f"HAVING count(*) > 1) d) AS violations")
        for c in schemas.NOT_NULL[t]:
            parts.append(f"SELECT {_q(t)}, 'not_null', {_q(c)}, (SELECT count(*) FROM {fx} WHERE {c} IS NULL)")
        for c, allowed in schemas.DOMAINS.get(t, {}).items():
            lst = ", ".join(_q(a) for a in allowed)
            parts.append(f"SELECT {_q(t)}, 'domain', {_q(c)}, "
                         f"(SELECT count(*) FROM {fx} WHERE {c} IS NOT NULL AND {c} NOT IN ({lst}))")
        for c, p, pc in schemas.FOREIGN_KEYS.get(t, []):
            if p not in tables:
                continue
            parts.append(f"SELECT {_q(t)}, 'foreign_key', {_q(f'{c}->{p}.{pc}')}, "
                         f"(SELECT count(*) FROM {fx} x WHERE {c} IS NOT NULL AND NOT EXISTS "
                         f"(SELECT 1 FROM {tables[p]} y WHERE y.{pc} = x.{c}))")
    body = "\nUNION ALL\n".join(parts)
    return _with(list(tables.values())) + (
        f"SELECT table_name, rule, column_name, CAST(violations AS BIGINT) AS violations FROM ({body}) r")


_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _similarity_sql(base: str, typed: str, names: str) -> str:
    """``base`` with ``top``: (typed, name, ratio, rank) of the three most similar names, by recursion over matching blocks."""
    best = """list_max(list_filter(flatten(list_transform(range(1, length(a) + 1),
      lambda i: list_transform(range(1, length(a) - i + 2), lambda k: {'k': k, 'first': -i}))),
      lambda m: contains(b, substr(a, -m.first, m.k))))"""
    return base.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
tx AS (SELECT DISTINCT typed FROM {typed} WHERE typed <> ''),
nm AS (SELECT DISTINCT operator_name AS name FROM {names} WHERE operator_name <> ''),
open_texts AS (SELECT typed FROM tx WHERE typed NOT IN (SELECT name FROM nm)),
blocks AS (
  SELECT typed, name, a, b, {best} AS m FROM (SELECT typed, name, name AS a, typed AS b FROM open_texts, nm
    WHERE 2.0 * least(length(typed), length(name)) / (length(typed) + length(name)) >= {K.FUZZY_CUTOFF})
  UNION ALL
  SELECT typed, name, a, b, {best} AS m FROM (
    SELECT typed, name, p.a AS a, p.b AS b FROM (
      SELECT typed, name, unnest([{{'a': substr(a, 1, -m.first - 1), 'b': substr(b, 1, strpos(b, substr(a, -m.first, m.k)) - 1)}},
                                  {{'a': substr(a, m.k - m.first), 'b': substr(b, strpos(b, substr(a, -m.first, m.k)) + m.k)}}]) AS p
      FROM blocks WHERE m IS NOT NULL)
    WHERE p.a <> '' AND p.b <> '')),
ratios AS (SELECT typed, name, 2.0 * coalesce(sum(m.k), 0) / (length(typed) + length(name)) AS ratio FROM blocks GROUP BY typed, name),
top AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY ratio DESC, name DESC) AS rank FROM ratios WHERE ratio >= {K.FUZZY_CUTOFF} QUALIFY rank <= {K.FUZZY_TOP})"""


def _resolver_sql() -> dict[str, str]:
    base = _with(["fx_operator_typed_info", "fx_operator_info"]) + f", texts AS (SELECT user_id, {_STRIP.format(x='typed')} AS typed FROM fx_operator_typed_info)"
    literal = _with(["fx_operator_typed", "fx_operator_names"]) + f", texts AS (SELECT user_id, typed AS raw, {_STRIP.format(x='typed')} AS typed FROM fx_operator_typed)"
    return {
        "operator_suggestions": _similarity_sql(base, "texts", "fx_operator_info") + """
SELECT typed, CAST(rank AS INTEGER) AS rank, name, round(ratio, 9) AS ratio FROM top""",
        "operator_resolution": _similarity_sql(literal, "texts", "fx_operator_names") + """,
listed AS (SELECT typed, string_agg(name, '|' ORDER BY rank) AS suggestions FROM top GROUP BY typed)
SELECT user_id, raw, typed, nm.name AS matched, suggestions,
  CASE WHEN typed = '' THEN 'blank' WHEN nm.name IS NOT NULL THEN 'exact' WHEN suggestions IS NOT NULL THEN 'suggest' ELSE 'none' END AS outcome
FROM texts LEFT JOIN nm ON nm.name = typed LEFT JOIN listed USING (typed)""",
        "operator_exact": base + """
SELECT user_id, typed, CASE WHEN typed = '' THEN 'blank' WHEN o.operator_name IS NOT NULL THEN 'exact' ELSE 'fuzzy' END AS outcome,
       o.operator_name AS matched
FROM texts LEFT JOIN (SELECT DISTINCT operator_name FROM fx_operator_info) o ON typed = o.operator_name""",
        "operator_fuzzy_pairs": base + f""",
tc AS (SELECT typed, ch, count(*) AS n FROM (SELECT typed, unnest(string_split(typed, '')) AS ch FROM (SELECT DISTINCT typed FROM texts WHERE typed <> '')) GROUP BY ALL),
nc AS (SELECT name, ch, count(*) AS m FROM (SELECT name, unnest(string_split(name, '')) AS ch FROM (SELECT DISTINCT operator_name AS name FROM fx_operator_info)) GROUP BY ALL),
common AS (SELECT typed, name, CAST(sum(least(n, m)) AS BIGINT) AS common FROM tc JOIN nc USING (ch) GROUP BY typed, name)
SELECT typed, name, common FROM common
WHERE 2.0 * least(length(typed), length(name)) / (length(typed) + length(name)) >= {K.FUZZY_CUTOFF}
  AND 2.0 * common / (length(typed) + length(name)) >= {K.FUZZY_CUTOFF}""",
    }


def _text_sql() -> dict[str, str]:
    q = {}
    docs_fx = ["fx_product_info", "fx_product_fixed", "fx_product_variable", "fx_product_mapping"]
    dec = lambda c, s: f"CAST(CAST(coalesce(CAST({c} AS DOUBLE), 0.0) AS DECIMAL(18,{s})) AS VARCHAR)"
    documents = f"""
SELECT product_id, category, {_STRIP.format(x='content')} AS page_content FROM (
  SELECT i.id AS product_id, i.category,
    printf({_q(K.DOC_HEADER)}, i.product_name, coalesce(i.product_type, '0'),
           CASE WHEN i.category = 'GUARANTEED' THEN {_q(K.DOC_KIND_GUARANTEED)} ELSE {_q(K.DOC_KIND_VARIABLE)} END)
    || CASE WHEN i.category = 'GUARANTEED' THEN
         printf({_q(K.DOC_GUARANTEED)}, CAST(CAST(coalesce(CAST(f.maturity AS DOUBLE), 0.0) AS BIGINT) AS VARCHAR),
                {dec('f.interest_rate', 2)})
       ELSE
         printf({_q(K.DOC_VARIABLE)}, coalesce(v.risk_level, '0'),
                CASE WHEN v.eligible_tdf = 'O' THEN {_q(K.DOC_TDF_IN)} ELSE {_q(K.DOC_TDF_OUT)} END,
                coalesce(CAST(v.launch_date AS VARCHAR), '0'),
                CAST(CAST(coalesce(CAST(v.total_net_worth AS DOUBLE), 0.0) AS BIGINT) AS VARCHAR),
                {dec('v.total_expense_ratio', 3)}, {dec('v.average_return_1y', 3)},
                {dec('v.average_return_3y', 3)}, {dec('v.average_return_5y', 3)})
       END AS content
  FROM fx_product_info i LEFT JOIN fx_product_fixed f ON i.id = f.id LEFT JOIN fx_product_variable v ON i.id = v.id
  WHERE i.category IN ('GUARANTEED', 'NON_GUARANTEED')) d"""
    q["rag_documents"] = _with(docs_fx) + documents

    silver = _q(K.VR_SILVER)
    items = f"""
items AS (
  SELECT p.user_id, 0 AS half, g.rank, g.product_id, g.product_name, CAST(format('{{:.1f}}', g.score) AS DOUBLE) AS dscore,
         g.reasons AS rp, g.interest_rate, g.risk_level
  FROM prof p JOIN greason g ON p.cand_key = g.cand_key AND p.risk_preference = g.risk_preference
  UNION ALL
  SELECT p.user_id, 1 AS half, v.rank, v.product_id, v.product_name, CAST(format('{{:.1f}}', v.total_score) AS DOUBLE) AS dscore,
         CASE WHEN p.is_silver THEN concat_ws(' | ', v.reasons, replace({silver}, '%s', CAST(p.period AS VARCHAR)))
              ELSE v.reasons END AS rp, v.interest_rate, v.risk_level
  FROM prof p JOIN vreason v ON p.cand_key = v.cand_key AND p.risk_preference = v.risk_preference
    AND p.is_silver = v.is_silver AND p.manages_self = v.manages_self
),
pctx AS (
  SELECT p.user_id,
    printf({_q(K.CTX_SUMMARY)}, p.risk_preference, format('{{:,}}', CAST(coalesce(p.investment_amount, 0) AS BIGINT)),
           printf('%.2f', p.grnt_ratio * 100), printf('%.2f', (CAST(1.0 AS DOUBLE) - p.grnt_ratio) * 100))
    || {_q(K.CTX_GUARANTEED_HEAD)}
    || coalesce((SELECT string_agg(printf({_q(K.CTX_ITEM)}, CAST(i.rank AS VARCHAR), i.product_name,
                   CAST(i.dscore AS VARCHAR), replace(i.rp, ' | ', ', ')), '' ORDER BY i.rank)
                 FROM items i WHERE i.user_id = p.user_id AND i.half = 0), '')
    || {_q(K.CTX_VARIABLE_HEAD)}
    || coalesce((SELECT string_agg(printf({_q(K.CTX_ITEM)}, CAST(i.rank AS VARCHAR), i.product_name,
                   CAST(i.dscore AS VARCHAR), replace(i.rp, ' | ', ', ')), '' ORDER BY i.rank)
                 FROM items i WHERE i.user_id = p.user_id AND i.half = 1), '') AS context,
    {_q(K.REASON_BLOCK_HEAD)}
    || coalesce((SELECT string_agg(printf({_q(K.REASON_BLOCK_ITEM)}, i.product_name, CAST(i.dscore AS VARCHAR),
                   replace(i.rp, ' | ', chr(10) || '  - ')), '' ORDER BY i.half, i.rank)
                 FROM items i WHERE i.user_id = p.user_id), '') AS reason_text,
    coalesce((SELECT string_agg(i.product_id, ',' ORDER BY i.half, i.rank) FROM items i
              WHERE i.user_id = p.user_id), '') AS candidate_ids,
    coalesce((SELECT string_agg(printf({_q(K.LIST_CONTEXT_ITEM)}, i.product_name, CAST(i.interest_rate AS VARCHAR),
                   i.risk_level, replace(i.rp, ' | ', '; ')), '' ORDER BY i.half, i.rank)
              FROM items i WHERE i.user_id = p.user_id), '') AS list_context,
    coalesce((SELECT string_agg(printf({_q(K.COMPARISON_CONTEXT_ITEM)}, i.product_name, CAST(i.interest_rate AS VARCHAR),
                   i.risk_level, replace(i.rp, ' | ', ', ')), '' ORDER BY i.half, i.rank)
              FROM items i WHERE i.user_id = p.user_id), '') AS comparison_context
  FROM prof p
)"""
    chat = _with([*_CATALOG_FX, "fx_turns", "fx_document_vectors"], PROFILE, CANDIDATES,
                 GUARANTEED.replace(f"rank <= {TOP_N}", f"rank <= {CHAT_TOP_N}"),
                 VARIABLE.replace(f"rank <= {TOP_N}", f"rank <= {CHAT_TOP_N}"), items, f"documents_text AS ({documents})")
    nearest = lambda keys, sep: f"""\
dist AS (
  SELECT {keys}, w.product_id,
    list_reduce(list_transform(list_zip(a.embedding, e.embedding),
        lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))),
      lambda x, y: x + y, CAST(0.0 AS DOUBLE)) AS distance
  FROM wanted w JOIN embeddings a ON a.vec_id = w.vec_id JOIN fx_document_vectors v ON v.product_id = w.product_id
    JOIN embeddings e ON e.vec_id = v.vec_id
),
hits AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY distance, product_id) AS nth FROM dist),
rag AS (SELECT {keys}, string_agg(page_content, {sep} ORDER BY nth) AS rag_text FROM hits JOIN documents_text USING (product_id)
        WHERE nth <= 3 GROUP BY {keys})"""  # noqa: E731
    requests = ", ".join(_q(r) for r in K.RECOMMEND_REQUESTS)
    is_request = f"{_STRIP.format(x='t.query')} IN ({requests})"
    q["chat_prompts_vectors"] = chat + f""",
wanted AS (SELECT DISTINCT t.conv_id, t.turn, t.vec_id, i.product_id FROM fx_turns t JOIN items i USING (user_id)),
{nearest('conv_id, turn', 'chr(10) || chr(10)')}
SELECT t.conv_id, t.turn, t.user_id, CASE WHEN p.user_id IS NULL THEN 'no_profile' ELSE 'answered' END AS outcome,
  CASE WHEN p.user_id IS NOT NULL THEN {_q(K.CHAT_SYSTEM)} END AS system_prompt,
  CASE WHEN p.user_id IS NOT NULL THEN printf({_q(K.CHAT_HUMAN)}, CAST(p.age AS VARCHAR), p.risk_preference, CAST(p.period AS VARCHAR), t.query,
    CASE WHEN {is_request} THEN printf({_q(K.CONTEXT_RECOMMEND)}, x.context, coalesce(r.rag_text, ''))
         ELSE printf({_q(K.CONTEXT_QUESTION)}, x.context, x.reason_text, coalesce(r.rag_text, '')) END) END AS human_prompt
FROM fx_turns t LEFT JOIN prof p ON p.user_id = t.user_id LEFT JOIN pctx x ON x.user_id = t.user_id
  LEFT JOIN rag r ON r.conv_id = t.conv_id AND r.turn = t.turn"""
    q["question_prompts_vectors"] = chat + f""",
wanted AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS vec_id, product_id FROM items),
{nearest('user_id', 'chr(10)')}
SELECT p.user_id, printf({_q(K.QUESTION_PROMPT)},
    CAST(to_json({{'user_id': p.user_id, 'age': p.age, 'period': p.period, 'risk_preference': p.risk_preference,
             'summary': {{'risk_preference': p.risk_preference, 'total_amt': CAST(coalesce(p.investment_amount, 0) AS BIGINT),
                         'grnt_ratio': p.grnt_ratio, 'ungrnt_ratio': CAST(1.0 AS DOUBLE) - p.grnt_ratio}}}}) AS VARCHAR),
    coalesce((SELECT string_agg(i.product_name, chr(10) ORDER BY i.half, i.rank) FROM items i WHERE i.user_id = p.user_id), ''),
    coalesce(r.rag_text, '')) AS prompt
FROM prof p LEFT JOIN rag r ON r.user_id = p.user_id"""
    base = _with([*_CATALOG_FX, "fx_turns"], PROFILE, CANDIDATES, GUARANTEED, VARIABLE, items)
    q["portfolio_context"] = base + """
SELECT user_id, context, reason_text, candidate_ids, list_context, comparison_context FROM pctx"""
    q["advice_prompts"] = base + f"""
SELECT t.conv_id, t.turn, t.user_id, CASE WHEN x.user_id IS NULL THEN 'no_profile' ELSE 'answered' END AS outcome,
       CASE WHEN x.user_id IS NOT NULL THEN printf({_q(K.ADVICE_PROMPT)}, x.context, t.query) END AS prompt
FROM fx_turns t LEFT JOIN pctx x ON x.user_id = t.user_id"""

    words = " OR ".join(f"coalesce(contains(text, {_q(w)}), false)" for w in K.COMPARE_WORDS)
    reqs = ", ".join(_q(r) for r in K.RECOMMEND_REQUESTS)
    q["intent"] = f"""
SELECT conv_id, turn, CASE WHEN {words} THEN 'compare' ELSE 'recommend' END AS intent,
       coalesce({_STRIP.format(x='text')} IN ({reqs}), false) AS is_recommendation
FROM conversations WHERE role = 'user'"""

    planted = " OR ".join(f"contains(t.query, {_q(w)})" for w in K.COMPARE_WORDS)
    q["turn_intent"] = _with(["fx_turns"]) + f"""
SELECT conv_id, turn, CASE WHEN {planted} THEN 'compare' ELSE 'recommend' END AS intent, {is_request} AS is_recommendation
FROM fx_turns t"""

    q["appended_turns"] = """
SELECT conv_id, turn, role, text FROM conversations
UNION ALL
SELECT c.conv_id, l.last + n.seq + 1 AS turn, n.role, c.text
FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) l USING (conv_id),
     (VALUES (0, 'user'), (1, 'assistant')) AS n(seq, role)
WHERE c.turn = 0"""

    q["filtered_knn"] = f"""
WITH q AS (
  SELECT vec_id AS query_id, embedding AS qvec, unnest(range(vec_id + 1, vec_id + {2 * 5 + 1})) AS doc_id
  FROM embeddings
),
p AS (
  SELECT q.query_id, q.doc_id,
    list_reduce(list_transform(list_zip(q.qvec, e.embedding),
        lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))),
      lambda a, b: a + b, CAST(0.0 AS DOUBLE)) AS distance
  FROM q JOIN embeddings e ON e.vec_id = q.doc_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id AS neighbor_id, round(distance, 6) AS distance
FROM r WHERE rank <= 3"""

    q["filtered_knn_fetch"] = """
WITH d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_reduce(list_transform(list_zip(q.embedding, e.embedding),
      lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))),
    lambda a, b: a + b, CAST(0.0 AS DOUBLE)) AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) <= 50)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INTEGER) AS rank, doc_id AS neighbor_id, round(distance, 6) AS distance
FROM near WHERE abs(doc_id - query_id) <= 40 AND (doc_id - query_id) % 2 = 0 QUALIFY rank <= 3"""

    q["parse_questions"] = f"""
WITH a AS (
  SELECT conv_id, turn,
    list_slice(list_transform(list_filter(string_split(text, chr(10)), lambda s: length(s) > {K.QUESTION_MIN_LEN}),
                              lambda s: {_STRIP.format(x='s')}), 1, {K.QUESTION_COUNT}) AS qs
  FROM conversations WHERE role = 'assistant'
)
SELECT conv_id, turn, CAST(generate_subscripts(qs, 1) AS INTEGER) AS q_idx, unnest(qs) AS question FROM a"""

    q["chat_history"] = """
SELECT conv_id, count(*) AS n_turns,
       CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS n_user,
       CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS n_assistant,
       arg_max(role, turn) AS last_role,
       max(CASE WHEN role = 'user' THEN turn END) AS last_user_turn,
       max(CASE WHEN role = 'assistant' THEN turn END) AS last_assistant_turn,
       CAST(sum(length(text)) AS BIGINT) AS history_chars,
       coalesce(max(CASE WHEN role = 'assistant' THEN turn END)
                > coalesce(max(CASE WHEN role = 'user' THEN turn END), -1), false) AS suggestions_valid
FROM conversations GROUP BY conv_id"""
    return q


def oracle_sql() -> dict[str, str]:
    """All oracle statements, keyed like the registered queries."""
    q = _scoring_sql()
    q.update(_survey_sql())
    q["catalog_integrity"] = _integrity_sql(INTEGRITY_NAMES)
    q["catalog_violations"] = _integrity_sql(DIRTY_NAMES)
    q.update(_resolver_sql())
    q.update(_text_sql())
    q["rejected_rows"] = _with(["fx_raw_product_fixed", "fx_product_info"]) + """,
r AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM fx_raw_product_fixed),
found AS (
  SELECT id, 'unreadable' AS rule, 'maturity' AS column_name, maturity AS value FROM r WHERE maturity IS NOT NULL AND TRY_CAST(maturity AS INTEGER) IS NULL
  UNION ALL SELECT id, 'unreadable', 'interest_rate', interest_rate FROM r WHERE interest_rate IS NOT NULL AND TRY_CAST(interest_rate AS DECIMAL(5, 2)) IS NULL
  UNION ALL SELECT id, 'not_null', 'id', id FROM r WHERE id IS NULL
  UNION ALL SELECT id, 'foreign_key', 'id->product_info.id', id FROM r WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM fx_product_info WHERE id IS NOT NULL)
  UNION ALL SELECT id, 'primary_key', 'id', coalesce(id, '') FROM r WHERE n > 1)
SELECT 'product_fixed' AS table_name, coalesce(id, 'NULL') AS key, rule, column_name, value FROM found"""
    q["products_by_names"] = _with(["fx_operator_info", "fx_product_mapping", "fx_product_info", "fx_product_fixed"]) + """
SELECT DISTINCT i.id AS product_id, i.product_name, i.category, CAST(f.interest_rate AS DOUBLE) AS interest_rate
FROM fx_operator_info o JOIN fx_product_mapping m ON m.operator_id = o.id JOIN fx_product_info i ON i.id = m.product_id LEFT JOIN fx_product_fixed f ON f.id = i.id
WHERE o.operator_name IN ('OP1', 'OP2', 'O''P3''); DROP TABLE x; --', '\\', ':names', '') AND i.category = 'GUARANTEED'"""
    share = " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.GUARANTEED_SHARE.items())
    fit = " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.TDF_FIT.items())
    q["profile_defaults"] = _with(["fx_profile_records"]) + f""",
r AS (SELECT user_id, coalesce(risk_preference, '{K.DEFAULT_RISK}') AS risk_preference, CAST(coalesce(investment_amount, {K.DEFAULT_AMOUNT}) AS BIGINT) AS investment_amount,
  CAST(coalesce(period, {K.DEFAULT_PERIOD}) AS INTEGER) AS period, coalesce(direct_manage, {str(K.DEFAULT_DIRECT_MANAGE).upper()}) AS manages_self, style_text
  FROM fx_profile_records)
SELECT user_id, risk_preference, investment_amount, period, period <= {K.SILVER_MAX_PERIOD} AS is_silver, manages_self,
  CASE WHEN manages_self THEN '{K.MANAGE_SELF}' ELSE '{K.MANAGE_EXPERT}' END AS style,
  CAST(CASE risk_preference {share} ELSE {K.GUARANTEED_SHARE_DEFAULT} END AS DOUBLE) AS grnt_ratio,
  CAST(CASE style_text {fit} ELSE {K.TDF_FIT_DEFAULT} END AS INTEGER) AS tdf_fit
FROM r"""
    q["display_rounding"] = """
SELECT p_partkey, x, CAST(format('{:.1f}', x) AS DOUBLE) AS shown
FROM (SELECT p_partkey, (p_partkey % 4001) / 20.0 AS x FROM part UNION ALL SELECT p_partkey, p_retailprice / 8 AS x FROM part)"""
    q["chat_history_stream"] = q["chat_history"]
    q["chat_prompts_stream"] = q["chat_prompts_vectors"]
    return q
