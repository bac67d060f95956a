"""Fixture adapter: driver tables -> the recommender's catalog and survey tables.

Each statement is plain SQL that both Spark and DuckDB accept. ``{name}`` marks a
table: Spark binds it to a DataFrame (``spark.sql(text, name=df)``), the oracle
renders it as a CTE or view name. Order matters: later statements read earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestegg import constants as K
from nestegg.sources.tables import read_table

FIXTURE_SQL: dict[str, str] = {}

FIXTURE_SQL["fx_operator_info"] = """
SELECT DISTINCT concat('O', lpad(CAST(s_suppkey % 44 + 1 AS STRING), 3, '0')) AS id,
       concat('OP', CAST(s_suppkey % 44 + 1 AS STRING)) AS operator_name
FROM {supplier}
"""

FIXTURE_SQL["fx_product_info"] = """
SELECT concat('X', lpad(CAST(p_partkey AS STRING), 8, '0')) AS id,
       concat(p_name, ' ', CAST(p_partkey AS STRING), ' ', CASE
         WHEN p_partkey % 20 = 0  THEN '정부보증채'
         WHEN p_partkey % 20 = 2  THEN '은행 예적금'
         WHEN p_partkey % 20 = 4  THEN '증권금융회사 예탁금'
         WHEN p_partkey % 20 = 6  THEN '저축은행 예적금'
         WHEN p_partkey % 20 = 8  THEN '발행어음 및 표지어음'
         WHEN p_partkey % 20 = 10 THEN '원리금파생상품결합사채'
         WHEN p_partkey % 20 = 12 THEN '금리연동형 보험'
         WHEN p_partkey % 20 = 14 THEN '이율보증형 보험'
         WHEN p_partkey % 20 = 16 THEN '환매조건부 매수계약'
         WHEN p_partkey % 2 = 0   THEN '기타'
         WHEN p_partkey % 6 = 1   THEN 'tdf2045'
         ELSE '펀드' END) AS product_name,
       p_type AS product_type,
       concat('P', lpad(CAST(p_partkey % 167 + 1 AS STRING), 3, '0')) AS provider_id,
       CASE WHEN p_partkey % 2 = 0 THEN 'GUARANTEED' ELSE 'NON_GUARANTEED' END AS category
FROM {part}
"""

FIXTURE_SQL["fx_product_fixed"] = """
SELECT concat('X', lpad(CAST(p_partkey AS STRING), 8, '0')) AS id,
       CAST(6 * (p_size % 10 + 1) AS INT) AS maturity,
       CAST(CAST((p_partkey * 37) % 500 AS DECIMAL(10,2)) / 100 AS DECIMAL(5,2)) AS interest_rate
FROM {part} WHERE p_partkey % 2 = 0 AND p_partkey % 29 <> 0
"""

FIXTURE_SQL["fx_product_variable"] = """
SELECT concat('X', lpad(CAST(p_partkey AS STRING), 8, '0')) AS id,
       CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN '정보없음'
            ELSE concat(CAST(p_size % 6 + 1 AS STRING), '등급') END AS risk_level,
       CASE p_partkey % 8 WHEN 1 THEN 'O' WHEN 3 THEN ' o ' ELSE 'X' END AS eligible_tdf,
       CASE WHEN p_partkey % 41 = 0 THEN NULL
            ELSE DATE '2012-01-01' + CAST((p_partkey * 97) % 5200 AS INT) END AS launch_date,
       CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE l.qty * 1000000 END AS total_net_worth,
       CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE CAST(CAST((p_partkey * 53) % 4000 - 1000 AS DECIMAL(10,2)) / 100 AS DECIMAL(10,3)) END AS average_return_1y,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(CAST((p_partkey * 59) % 4000 - 1000 AS DECIMAL(10,2)) / 100 AS DECIMAL(10,3)) END AS average_return_3y,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(CAST((p_partkey * 61) % 4000 - 1000 AS DECIMAL(10,2)) / 100 AS DECIMAL(10,3)) END AS average_return_5y,
       CAST(NULL AS DECIMAL(10,3)) AS average_return_7y,
       CAST(NULL AS DECIMAL(10,3)) AS average_return_10y,
       CAST(CAST((p_partkey * 13) % 300 AS DECIMAL(10,2)) / 100 AS DECIMAL(5,3)) AS total_expense_ratio
FROM {part} LEFT JOIN (
  SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM {lineitem} GROUP BY l_partkey
) l ON p_partkey = l.l_partkey
WHERE p_partkey % 2 = 1
"""

FIXTURE_SQL["fx_product_mapping"] = """
SELECT DISTINCT concat('X', lpad(CAST(l_partkey AS STRING), 8, '0')) AS product_id,
       concat('O', lpad(CAST(l_suppkey % 44 + 1 AS STRING), 3, '0')) AS operator_id,
       CASE l_returnflag WHEN 'A' THEN 'DB' WHEN 'N' THEN 'DC' ELSE 'IRP' END AS subscriber_type
FROM {lineitem}
"""

FIXTURE_SQL["fx_survey"] = """
SELECT c_custkey AS user_id, c_name AS name,
       CAST(CASE WHEN c_custkey % 25 < 2 THEN 25 ELSE 15 + c_custkey % 60 END AS INT) AS age,
       CAST(CASE WHEN c_custkey % 25 < 2 THEN 4 + c_custkey % 9 ELSE (c_custkey * 7) % 15 END AS INT) AS period,
       CAST(CASE WHEN c_custkey % 25 < 2 THEN 1 ELSE c_custkey % 7 + 1 END AS INT) AS experience,
       CAST(CASE WHEN c_custkey % 25 < 2 THEN 1 ELSE (c_custkey * 3) % 4 + 1 END AS INT) AS psychology,
       CAST(CASE WHEN c_custkey % 25 = 0 THEN 4 WHEN c_custkey % 25 = 1 THEN 2 ELSE (c_custkey * 5 + c_nationkey) % 4 + 1 END AS INT) AS loss_level,
       CAST(CASE WHEN c_custkey % 25 < 2 THEN 1 ELSE (c_custkey * 11 + c_nationkey) % 5 + 1 END AS INT) AS finance_knowledge,
       CAST(CASE WHEN c_custkey % 25 < 2 THEN 1 ELSE (c_custkey * 13) % 5 + 1 END AS INT) AS investment_goal,
       CAST(CASE WHEN c_custkey % 25 < 2 THEN 1 ELSE (c_custkey * 17 + c_nationkey) % 4 + 1 END AS INT) AS pension_ratio,
       CAST(CASE WHEN c_custkey % 25 < 2 THEN 1 ELSE (c_custkey * 19 + c_nationkey) % 3 + 1 END AS INT) AS expected_income,
       CAST(floor(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END) AS BIGINT) * 10000 AS investment_amount,
       split(CASE WHEN c_custkey % 3 = 0
                  THEN concat('OP', CAST(c_custkey % 44 + 1 AS STRING), ',OP', CAST((c_custkey + 7) % 44 + 1 AS STRING))
                  ELSE concat('OP', CAST(c_custkey % 44 + 1 AS STRING)) END, ',') AS pension_operator,
       c_nationkey % 2 = 0 AS direct_manage
FROM {customer}
"""

FIXTURE_SQL["fx_operator_typed"] = """
SELECT u.c_custkey AS user_id,
       CASE u.c_custkey % 6 WHEN 0 THEN o.operator_name WHEN 1 THEN concat('  ', o.operator_name, ' ')
         WHEN 2 THEN substr(o.operator_name, 2) WHEN 3 THEN concat(substr(o.operator_name, 1, 2), 'x', substr(o.operator_name, 3))
         WHEN 4 THEN '   ' ELSE 'qqqq' END AS typed
FROM {customer} u JOIN (VALUES (0,'DB생명보험'),(1,'삼성증권'),(2,'삼성생명보험'),(3,'한국투자증권'),(4,'미래에셋증권'),
     (5,'한화투자증권'),(6,'신한투자증권'),(7,'KB증권'),(8,'iM증권'),(9,'하나은행')) AS o(k, operator_name)
  ON u.c_custkey % 10 = o.k
"""

# Operator dimension the typed names are resolved against: the names typed above.
FIXTURE_SQL["fx_operator_names"] = """
SELECT DISTINCT operator_name FROM (VALUES (0,'DB생명보험'),(1,'삼성증권'),(2,'삼성생명보험'),(3,'한국투자증권'),(4,'미래에셋증권'),
     (5,'한화투자증권'),(6,'신한투자증권'),(7,'KB증권'),(8,'iM증권'),(9,'하나은행')) AS o(k, operator_name)
"""

# Partly answered surveys: user u has answered the first (u % 13) of the 12 steps.
_partial_cols = []
for _i, _key in enumerate(K.SURVEY_KEYS):
    _partial_cols.append(f"CASE WHEN user_id % 13 > {_i} THEN {_key} END AS {_key}")
FIXTURE_SQL["fx_survey_partial"] = (
    "SELECT user_id, " + ",\n       ".join(_partial_cols) + "\nFROM {fx_survey}"
)

# Raw widget answers, one row per (user, step): numbers as typed, radio choices as "<code>. <text>".
_raw_parts = []
for _key, _label, _kind in K.SURVEY_STEPS:
    if _key == "investment_amount":
        value = f"CAST(CAST({_key} / {K.AMOUNT_UNIT} AS BIGINT) AS STRING)"
    elif _key == "pension_operator":
        # The typed list as entered (same rule as fx_survey.pension_operator).
        value = ("CASE WHEN user_id % 3 = 0 THEN concat('OP', CAST(user_id % 44 + 1 AS STRING), ',OP', "
                 "CAST((user_id + 7) % 44 + 1 AS STRING)) ELSE concat('OP', CAST(user_id % 44 + 1 AS STRING)) END")
    elif _key == "direct_manage":
        value = "CASE WHEN direct_manage THEN '1. 내가 직접 관리' ELSE '2. 전문가에게 맡김' END"
    elif _kind == "number":
        value = f"CAST({_key} AS STRING)"
    else:
        value = f"concat(CAST({_key} AS STRING), '. 응답')"
    _raw_parts.append(f"SELECT user_id, '{_key}' AS step_key, {value} AS answer FROM {{fx_survey}}")
FIXTURE_SQL["fx_raw_answers"] = "\nUNION ALL\n".join(_raw_parts)

FIXTURE_SQL["fx_provider_info"] = """
SELECT DISTINCT provider_id AS id, concat('PROVIDER ', provider_id) AS provider_name FROM {fx_product_info}
"""

# The catalog with planted violations of every kind of rule (n: the product's number).
FIXTURE_SQL["fx_dirty_product_info"] = """
SELECT CASE WHEN n % 97 = 0 THEN NULL ELSE id END AS id, CASE WHEN n % 89 = 0 THEN NULL ELSE product_name END AS product_name,
       product_type, CASE WHEN n % 83 = 0 THEN 'P999' ELSE provider_id END AS provider_id,
       CASE WHEN n % 79 = 0 THEN 'ETC' WHEN n % 73 = 0 THEN NULL ELSE category END AS category
FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM {fx_product_info}) p
UNION ALL
SELECT id, product_name, product_type, provider_id, category FROM {fx_product_info} WHERE CAST(substr(id, 2) AS BIGINT) % 71 = 0
"""

FIXTURE_SQL["fx_dirty_product_fixed"] = """
SELECT id, maturity, interest_rate FROM {fx_product_fixed}
UNION ALL
SELECT id, maturity, interest_rate FROM {fx_product_fixed} WHERE CAST(substr(id, 2) AS BIGINT) % 61 = 0
"""

FIXTURE_SQL["fx_dirty_operator_info"] = """
SELECT id, CASE WHEN id = 'O005' THEN NULL ELSE operator_name END AS operator_name FROM {fx_operator_info} WHERE id <> 'O003'
"""

FIXTURE_SQL["fx_dirty_product_mapping"] = """
SELECT product_id, operator_id, CASE WHEN operator_id = 'O007' THEN NULL ELSE subscriber_type END AS subscriber_type
FROM {fx_product_mapping}
"""

# Typed names against the operator dimension: exact, padded, shortened, misspelt, blank, unlike any.
FIXTURE_SQL["fx_operator_typed_info"] = """
SELECT c_custkey AS user_id, CASE c_custkey % 6 WHEN 0 THEN name WHEN 1 THEN concat('  ', name, ' ') WHEN 2 THEN substr(name, 2)
         WHEN 3 THEN concat(substr(name, 1, 2), 'x', substr(name, 3)) WHEN 4 THEN '   ' ELSE 'qqqq' END AS typed
FROM (SELECT c_custkey, concat('OP', CAST(c_custkey % 50 + 1 AS STRING)) AS name FROM {customer}) c
"""

# User turns with planted comparison words, request literals and users without a profile.
FIXTURE_SQL["fx_turns"] = """
SELECT conv_id, turn, CASE WHEN conv_id % 17 = 16 THEN conv_id + 1000000000 ELSE conv_id END AS user_id,
       CASE (conv_id + turn) % 4 WHEN 1 THEN concat(text, ' 비교해 주세요') WHEN 2 THEN ' 추천해주세요 ' WHEN 3 THEN '상품 차이' ELSE text END AS query,
       (conv_id * 7 + turn) % (SELECT count(*) FROM {embeddings}) AS vec_id
FROM {conversations} WHERE role = 'user'
"""

# Product numbers as a source delivers them, as texts; some are unreadable, some keys are missing or repeated.
FIXTURE_SQL["fx_raw_product_fixed"] = """
SELECT id, CASE WHEN n % 11 = 3 THEN 'abc' WHEN n % 11 = 5 THEN '' WHEN n % 11 = 7 THEN NULL ELSE CAST(maturity AS STRING) END AS maturity,
       CASE WHEN n % 13 = 2 THEN 'N/A' WHEN n % 13 = 4 THEN '3,5%' ELSE CAST(interest_rate AS STRING) END AS interest_rate
FROM (SELECT CASE WHEN CAST(substr(id, 2) AS BIGINT) % 97 = 1 THEN NULL WHEN CAST(substr(id, 2) AS BIGINT) % 89 = 2 THEN concat('X', id) ELSE id END AS id,
             maturity, interest_rate, CAST(substr(id, 2) AS BIGINT) AS n FROM {fx_product_fixed}
      UNION ALL SELECT id, maturity, interest_rate, 0 AS n FROM {fx_product_fixed} WHERE CAST(substr(id, 2) AS BIGINT) % 53 = 0) x
"""

# Stored profile records with missing fields, and management styles as texts.
def _lookup_sql(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


FIXTURE_SQL["fx_profile_records"] = f"""
SELECT c_custkey AS user_id, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'nothing' ELSE {_lookup_sql('c_custkey % 5', [*K.GUARANTEED_SHARE])} END AS risk_preference,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey * 1000 END AS investment_amount,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 13 AS INT) END AS period,
       CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS direct_manage,
       {_lookup_sql('c_custkey % 4', [*K.TDF_FIT, 'no answer'])} AS style_text
FROM {{customer}}
"""

# Precomputed document vectors: a product's number picks a row of the embeddings.
FIXTURE_SQL["fx_document_vectors"] = """
SELECT id AS product_id, CAST(substr(id, 2) AS BIGINT) % (SELECT count(*) FROM {embeddings}) AS vec_id FROM {fx_product_info}
"""

FIXTURE_DEPS = {
    "fx_operator_info": ["supplier"],
    "fx_product_info": ["part"],
    "fx_product_fixed": ["part"],
    "fx_product_variable": ["part", "lineitem"],
    "fx_product_mapping": ["lineitem"],
    "fx_survey": ["customer"],
    "fx_operator_typed": ["customer"],
    "fx_operator_names": [],
    "fx_survey_partial": ["fx_survey"],
    "fx_raw_answers": ["fx_survey"],
    "fx_provider_info": ["fx_product_info"],
    "fx_dirty_product_info": ["fx_product_info"],
    "fx_dirty_product_fixed": ["fx_product_fixed"],
    "fx_dirty_operator_info": ["fx_operator_info"],
    "fx_dirty_product_mapping": ["fx_product_mapping"],
    "fx_operator_typed_info": ["customer"],
    "fx_turns": ["conversations", "embeddings"],
    "fx_raw_product_fixed": ["fx_product_fixed"],
    "fx_profile_records": ["customer"],
    "fx_document_vectors": ["fx_product_info", "embeddings"],
}

CATALOG_NAMES = {
    "operator_info": "fx_operator_info",
    "product_info": "fx_product_info",
    "product_fixed": "fx_product_fixed",
    "product_variable": "fx_product_variable",
    "product_mapping": "fx_product_mapping",
}
INTEGRITY_NAMES = {"provider_info": "fx_provider_info", **CATALOG_NAMES}
DIRTY_NAMES = INTEGRITY_NAMES | {
    t: f"fx_dirty_{t}" for t in ("product_info", "product_fixed", "operator_info", "product_mapping")}


def fixture(spark: SparkSession, sf_dir: str, name: str, _cache: dict | None = None) -> DataFrame:
    """Build fixture ``name`` from the driver tables under ``sf_dir``."""
    cache = {} if _cache is None else _cache
    if name in cache:
        return cache[name]
    args = {}
    for dep in FIXTURE_DEPS[name]:
        args[dep] = fixture(spark, sf_dir, dep, cache) if dep.startswith("fx_") else read_table(spark, sf_dir, dep)
    df = spark.sql(FIXTURE_SQL[name], **args) if args else spark.sql(FIXTURE_SQL[name])
    cache[name] = df
    return df


def fixture_catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five catalog tables keyed by their catalog names."""
    cache: dict = {}
    return {k: fixture(spark, sf_dir, v, cache) for k, v in CATALOG_NAMES.items()}


def oracle_ctes(names: list[str]) -> str:
    """``WITH`` clause (without the keyword) defining ``names`` and their dependencies for DuckDB."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in FIXTURE_DEPS[n]:
            if d.startswith("fx_"):
                visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        body = FIXTURE_SQL[n].format(**{d: d for d in FIXTURE_DEPS[n]})
        parts.append(f"{n} AS (\n{body.strip()}\n)")
    return ",\n".join(parts)
