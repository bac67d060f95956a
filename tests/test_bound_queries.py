"""Queries with bound parameters, and rows that are checked before they are written."""

import os
import tempfile
from collections import Counter

import pytest
from pyspark.errors import AnalysisException, PySparkException

from nestegg.operators import integrity as I
from nestegg.sources.catalog import run_query

HOSTILE = ["a", "O'Brien", "x') OR 1=1 --", "\\", '"', ":names", "{t}", "", "ü"]


def test_list_of_hostile_names_equals_a_semi_join(spark):
    rows = [(i, n) for i, n in enumerate([*HOSTILE, "other", None, "x", "OR"])]
    table = spark.createDataFrame(rows, "id int, name string")
    for names in (HOSTILE, HOSTILE[1:3], ["x') OR 1=1 --"], []):
        got = run_query(spark, "SELECT id FROM {t} WHERE name IN (:names) AND name <> ':names, ''x' AND id::int >= :low", {"names": names, "low": 0}, {"t": table}).collect()
        assert sorted(r.id for r in got) == [i for i, n in rows if n in names]


def test_list_reaches_the_scan(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="nestegg-bound-"), "t")
    spark.range(100).selectExpr("id", "concat('OP', id) AS name").write.parquet(path)
    found = run_query(spark, "SELECT id FROM {t} WHERE name IN (:names)", {"names": ["OP1", "OP'2"]}, {"t": spark.read.parquet(path)})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(name, [OP'2,OP1])" in plan or "In(name, [OP1,OP'2])" in plan
    assert [r.id for r in found.collect()] == [1]


def test_bad_queries_raise(spark):
    for bad in ("SELECT nothing FROM {t}", "SELEC id FROM {t}", "SELECT id FROM {t} WHERE name = :unbound"):
        with pytest.raises(AnalysisException):
            run_query(spark, bad, {}, {"t": spark.range(3).selectExpr("id", "'a' AS name")})
    with pytest.raises(PySparkException):
        run_query(spark, "SELECT raise_error('no database') FROM {t}", {}, {"t": spark.range(3)}).collect()


def test_rows_are_split_at_the_write(spark):
    path = tempfile.mkdtemp(prefix="nestegg-checked-")
    parents = {"provider_info": spark.createDataFrame([("p1", "P")], "id string, provider_name string")}
    raw = spark.createDataFrame(
        [("a", "A", "t", "p1", "GUARANTEED"), ("b", None, "t", "p9", "OTHER"), ("c", "C", None, None, None), ("c", "C2", None, "p1", "NON_GUARANTEED"), (None, "N", None, None, None)],
        "id string, product_name string, product_type string, provider_id string, category string")
    assert I.write_checked("product_info", raw, path, parents) == {"rows": 5, "good": 1, "rejected": 4}
    assert [r.id for r in spark.read.parquet(f"{path}/product_info").collect()] == ["a"]
    got = sorted(map(tuple, spark.read.parquet(f"{path}/product_info_rejected").select("key", "rule", "column_name", "value").collect()), key=str)
    assert got == sorted([("b", "not_null", "product_name", None), ("b", "domain", "category", "OTHER"), ("b", "foreign_key", "provider_id->provider_info.id", "p9"),
                          ("c", "primary_key", "id", "c"), ("c", "primary_key", "id", "c"), ("NULL", "not_null", "id", None)], key=str)


def test_unreadable_values_are_told_and_absent_columns_are_null(spark):
    raw = spark.createDataFrame([("a", "12", "1.5"), ("b", "twelve", "9999999"), ("c", None, "")], "id string, maturity string, interest_rate string")
    rows = I.checked_rows("product_fixed", raw)
    assert rows.columns == ["id", "maturity", "interest_rate", "rejections"]
    got = {r.id: sorted((x.column_name, x.value) for x in r.rejections) for r in rows.collect()}
    assert got == {"a": [], "b": [("interest_rate", "9999999"), ("maturity", "twelve")], "c": [("interest_rate", "")]}
    assert I.checked_rows("product_fixed", raw.drop("maturity")).where("id = 'a'").first().maturity is None


def test_rejections_agree_with_the_report(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("driver test data not present")
    from nestegg.plans.queries import Context
    tables = Context(spark, "/root/testdata/sf0.001").dirty_tables
    report = {(r.table_name, r.rule, r.column_name): r.violations for r in I.integrity_report(tables).collect()}
    got, keys = Counter(), set()
    for name, df in tables.items():
        for r in I.rejected_rows(name, I.checked_rows(name, df, tables)).collect():
            if r.rule == "primary_key":
                keys.add((r.table_name, r.rule, r.column_name, r.key))
            else:
                got[(r.table_name, r.rule, r.column_name)] += 1
    got.update(k[:3] for k in keys)  # the report counts repeated keys, not their rows
    assert sum(got.values()) > 0
    assert {k: v for k, v in report.items() if v} == dict(got)
