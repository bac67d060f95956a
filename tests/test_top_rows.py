"""Rankings sort few rows; candidate rows are not shuffled when the catalog is too large to broadcast."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SURVEY_DDL, survey_row

from nestegg import session
from nestegg.operators import variable as V
from nestegg.operators.candidates import near_top
from nestegg.operators.portfolio import Hub
from nestegg.operators.survey import build_profiles

DDL = "k string, j string, product_id string, score double"


def test_few_rows_come_to_the_sort(spark):
    many = spark.range(20_000).select(
        F.concat(F.lit("k"), F.col("id") % 2).alias("k"), F.lit(None).cast("string").alias("j"), F.concat(F.lit("p"), "id").alias("product_id"),
        F.when(F.col("id") % 5 > 0, F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double")).alias("score"))
    odd = spark.createDataFrame([("few", "x", "a", 1.0), ("few", "x", "b", None), ("none", None, "c", None), ("none", None, "d", None),
                                 *[("ties", "x", f"t{i:02d}", 7.0) for i in range(90)], ("nan", "x", "e", float("nan")), ("nan", "x", "f", 1.0)], DDL)
    rows = many.unionByName(odd)
    near = near_top(rows, ["k", "j"], "score", 5, 10)
    assert near.where("k like 'k_'").count() < 200
    order = Window.partitionBy("k", "j").orderBy(F.col("score").desc_nulls_last(), "product_id")
    first = lambda df: sorted(map(repr, df.withColumn("rank", F.row_number().over(order)).where("rank <= 5").collect()))
    assert first(near) == first(rows)
    assert near_top(rows, ["k", "j"], "score", 5) is rows


@pytest.fixture
def catalog(spark):
    rnd, ids = random.Random(3), [f"P{i:03d}" for i in range(100)]
    info = [(i, "혼합", "T", rnd.choice(["GUARANTEED", "NON_GUARANTEED"])) for i in ids]
    variable = [(i, "3등급", "O", "2015-01-01", rnd.choice([None, 5.0, 5.0, 6.0, float(rnd.randrange(40))]), 0.1, 1.0, 2.0, 3.0) for i in ids]
    return {
        "product_info": spark.createDataFrame(info, "id string, product_name string, product_type string, category string"),
        "product_fixed": spark.createDataFrame([(i, 12, 1.5) for i in ids], "id string, maturity int, interest_rate double"),
        "product_variable": spark.createDataFrame(variable, "id string, risk_level string, eligible_tdf string, launch_date string, total_net_worth double, "
                                                  "total_expense_ratio double, average_return_1y double, average_return_3y double, average_return_5y double"),
        "operator_info": spark.createDataFrame([(f"o{i}", f"OP{i}") for i in range(5)], "id string, operator_name string"),
        "product_mapping": spark.createDataFrame([(rnd.choice(ids), f"o{rnd.randrange(5)}") for _ in range(300)], "product_id string, operator_id string"),
    }


def test_a_large_catalog_does_not_shuffle_candidate_rows(spark, catalog, monkeypatch):
    users = [survey_row(i, pension_operator=[f"OP{i % 5}", f"OP{i % 3}"], loss_level=1 + i % 4) for i in range(20)]
    profiles = build_profiles(spark.createDataFrame(users, SURVEY_DDL))
    small = Hub(profiles, catalog, "2026-01-01", bucket_bits=5)
    want = sorted(map(repr, small.v_components.collect()))
    monkeypatch.setattr(session, "BROADCAST_MAX_BYTES", 320 * 30)  # 30 rows
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        hub = Hub(profiles, catalog, "2026-01-01", bucket_bits=5)
        assert sorted(map(repr, hub.v_components.collect())) == want
        plan = V.variable_topn(hub.v_components, hub.segments, 3, hub.set_rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastExchange" in plan and "nth" in plan
    assert not re.search(r"Exchange hashpartitioning\([^)]*(place|tie|product_id)", plan)
