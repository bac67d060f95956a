"""Candidate sets from operator bitmaps: the same rows, statistics and ranks as from (set, product) pairs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SURVEY_DDL, survey_row

from nestegg.operators import bitmaps as B
from nestegg.operators.candidates import average_rank, candidate_pairs, candidate_sets, set_stats
from nestegg.operators.portfolio import Hub, Scored
from nestegg.operators.survey import build_profiles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dirty(spark):
    """Profiles and a catalog with ties over many buckets, NULL values and categories, repeated mappings, unused operators."""
    rnd = random.Random(4)
    ops = [f"OP{i}" for i in range(9)]
    users = [survey_row(i, pension_operator=rnd.sample(ops, rnd.randrange(1, 5)), period=rnd.randrange(12), loss_level=1 + i % 4, direct_manage=bool(i % 2)) for i in range(40)]
    users += [survey_row(100, pension_operator=["NOBODY"]), survey_row(101, pension_operator=[]), survey_row(102, pension_operator=None)]
    ids = [f"P{i:03d}" for i in range(120)]
    info = [(i, rnd.choice(["안정 예금", "인버스 주식", "TDF 2040", "혼합"]), "T", rnd.choice(["GUARANTEED", "NON_GUARANTEED", "NON_GUARANTEED", None])) for i in ids]
    number = lambda *values: rnd.choice([None, *values])
    fixed = [(i, 12, number(1.5, 2.5, 3.25)) for i in ids[::2]]
    variable = [(i, rnd.choice(["1등급", "3등급", "6", "9", None, "x"]), "O", "2015-01-01", number(5.0, 5.0, 5.0, float(rnd.randrange(40))), number(0.1, 0.5),
                 number(1.0, -2.0), number(3.0), number(4.0, 8.0)) for i in ids[:90]]
    mapping = [(rnd.choice(ids), f"o{rnd.randrange(11)}") for _ in range(600)]
    catalog = {
        "product_info": spark.createDataFrame(info, "id string, product_name string, product_type string, category string"),
        "product_fixed": spark.createDataFrame(fixed, "id string, maturity int, interest_rate double"),
        "product_variable": spark.createDataFrame(variable, "id string, risk_level string, eligible_tdf string, launch_date string, total_net_worth double, "
                                                  "total_expense_ratio double, average_return_1y double, average_return_3y double, average_return_5y double"),
        "operator_info": spark.createDataFrame([(f"o{i}", f"OP{i}") for i in range(11)], "id string, operator_name string"),
        "product_mapping": spark.createDataFrame(mapping, "product_id string, operator_id string"),
    }
    return build_profiles(spark.createDataFrame(users, SURVEY_DDL)), catalog


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("missing", ["zero", "null"])
@pytest.mark.parametrize("bucket_bits", [2, 4, B.BUCKET_BITS])
def test_hub_equals_pairs(dirty, missing, bucket_bits):
    profiles, catalog = dirty
    hub = Hub(profiles, catalog, "2026-01-01", missing=missing, bucket_bits=bucket_bits)
    pairs = candidate_pairs(candidate_sets(profiles), catalog)
    assert rows_of(hub.candidates, "cand_key", "product_id") == rows_of(pairs, "cand_key", "product_id")
    wide = pairs.join(hub.products, "product_id")
    stats = set_stats(wide)
    assert rows_of(hub.stats, "cand_key", "category", *B.EXTREMES) == rows_of(stats, "cand_key", "category", *B.EXTREMES)
    variable = wide.where("category = 'NON_GUARANTEED'")
    n = stats.where("category = 'NON_GUARANTEED'").select("cand_key", "n_worth")
    want = average_rank(variable, ["cand_key"], "total_net_worth", out="r").join(n, "cand_key").withColumn(
        "score_a", F.when(F.col("n_worth") > 1, F.coalesce(F.lit(100.0) * (F.col("r") - 1) / (F.col("n_worth") - 1), F.lit(0.0))).otherwise(F.lit(50.0)))
    assert rows_of(hub.v_components, "cand_key", "product_id", "score_a") == rows_of(want, "cand_key", "product_id", "score_a")
    assert hub.slots.spans == (bucket_bits < B.BUCKET_BITS)


def test_every_bit_comes_back(spark):
    rows = spark.range(0, 1 << B.BUCKET_BITS, 7).select(F.lit("s").alias("cand_key"), F.lit(3).alias("bucket"), F.col("id").cast("int").alias("place"))
    rows = rows.unionByName(spark.createDataFrame([("t", 0, p) for p in (0, 31, 32, 32767)], "cand_key string, bucket int, place int"))
    sets = rows.groupBy("cand_key", "bucket").agg(F.bitmap_construct_agg(F.col("place")).alias("bits"))
    assert rows_of(B.expanded(sets), "cand_key", "bucket", "place") == rows_of(rows, "cand_key", "bucket", "place")


def test_catalog_without_products(spark, dirty):
    profiles, catalog = dirty
    none = {k: (v.limit(0) if k.startswith("product") else v) for k, v in catalog.items()}
    hub = Hub(profiles, none, "2026-01-01")
    assert hub.candidates.count() == 0 and hub.v_components.count() == 0
    assert Scored(profiles, hub=hub).v_top.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_sets_and_products_are_expanded_without_a_shuffle_of_their_rows(spark):
    """Between the bitmaps and the map-side limit of the ranking no exchange moves (set, product) rows."""
    from nestegg.operators import variable as V
    from nestegg.plans.queries import Context

    hub = Context(spark, SF).hub
    plan = V.variable_topn(hub.v_components, hub.segments, 3, hub.set_rows)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    limits = [i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Partial" in x]
    first_explode = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert limits and limits[0] < first_explode
    main = [x for x in lines[limits[0]:first_explode] if "Exchange hashpartitioning" in x]
    assert all("cand_key" not in x or "bucket" not in x for x in main)
    assert "REPARTITION_BY_NUM" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
