"""Fixed storage schemas of the catalog and the survey/profile tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


PROVIDER_INFO = T.StructType([_f("id", S, False), _f("provider_name", S, False)])
OPERATOR_INFO = T.StructType([_f("id", S, False), _f("operator_name", S, False)])
PRODUCT_INFO = T.StructType([
    _f("id", S, False), _f("product_name", S, False), _f("product_type", S),
    _f("provider_id", S), _f("category", S),
])
PRODUCT_FIXED = T.StructType([_f("id", S, False), _f("maturity", I), _f("interest_rate", T.DecimalType(5, 2))])
PRODUCT_VARIABLE = T.StructType([
    _f("id", S, False), _f("risk_level", S), _f("eligible_tdf", S), _f("launch_date", T.DateType()),
    _f("total_net_worth", L),
    _f("average_return_1y", T.DecimalType(10, 3)), _f("average_return_3y", T.DecimalType(10, 3)),
    _f("average_return_5y", T.DecimalType(10, 3)), _f("average_return_7y", T.DecimalType(10, 3)),
    _f("average_return_10y", T.DecimalType(10, 3)), _f("total_expense_ratio", T.DecimalType(5, 3)),
])
PRODUCT_MAPPING = T.StructType([_f("product_id", S, False), _f("operator_id", S, False),
                                _f("subscriber_type", S, False)])

CATALOG = {
    "provider_info": PROVIDER_INFO,
    "operator_info": OPERATOR_INFO,
    "product_info": PRODUCT_INFO,
    "product_fixed": PRODUCT_FIXED,
    "product_variable": PRODUCT_VARIABLE,
    "product_mapping": PRODUCT_MAPPING,
}

# Primary keys, foreign keys (column, parent table, parent column), not-null and domain rules.
PRIMARY_KEYS = {
    "provider_info": ["id"], "operator_info": ["id"], "product_info": ["id"],
    "product_fixed": ["id"], "product_variable": ["id"],
    "product_mapping": ["product_id", "operator_id", "subscriber_type"],
}
FOREIGN_KEYS = {
    "product_info": [("provider_id", "provider_info", "id")],
    "product_fixed": [("id", "product_info", "id")],
    "product_variable": [("id", "product_info", "id")],
    "product_mapping": [("product_id", "product_info", "id"), ("operator_id", "operator_info", "id")],
}
NOT_NULL = {t: [f.name for f in s.fields if not f.nullable] for t, s in CATALOG.items()}
DOMAINS = {"product_info": {"category": ["GUARANTEED", "NON_GUARANTEED"]}}

SURVEY_ANSWERS = T.StructType([
    _f("user_id", L), _f("name", S), _f("age", I), _f("period", I), _f("experience", I),
    _f("psychology", I), _f("loss_level", I), _f("finance_knowledge", I), _f("investment_goal", I),
    _f("pension_ratio", I), _f("expected_income", I), _f("investment_amount", L),
    _f("pension_operator", T.ArrayType(S)), _f("direct_manage", B),
])
RAW_ANSWERS = T.StructType([_f("user_id", L), _f("step_key", S), _f("answer", S)])
CHAT_MESSAGE = T.StructType([_f("conv_id", L), _f("turn", L), _f("role", S), _f("content", S)])
