"""FIXTURES.md §4 edge rows not covered elsewhere, catalog loading, resolution hand-off, turn append."""

import os
import tempfile

from conftest import SURVEY_DDL, survey_row

from nestegg.operators.candidates import candidates, set_stats, split_category, with_stats
from nestegg.operators.resolve import apply_resolution, resolve_operators
from nestegg.operators.text import append_turns, chat_history
from nestegg.operators.variable import variable_components
from nestegg.sources.catalog import load_catalog


def _catalog(spark, variable_rows, fixed_rows, info_rows):
    return {
        "operator_info": spark.createDataFrame([("O1", "A")], "id string, operator_name string"),
        "product_info": spark.createDataFrame(info_rows, "id string, product_name string, product_type string, "
                                                         "provider_id string, category string"),
        "product_fixed": spark.createDataFrame(fixed_rows, "id string, maturity int, interest_rate double"),
        "product_variable": spark.createDataFrame(
            variable_rows, "id string, risk_level string, eligible_tdf string, launch_date date, total_net_worth long, "
                           "average_return_1y double, average_return_3y double, average_return_5y double, "
                           "total_expense_ratio double"),
        "product_mapping": spark.createDataFrame([(r[0], "O1", "DB") for r in info_rows],
                                                 "product_id string, operator_id string, subscriber_type string"),
    }


def test_constant_columns_and_single_product(spark):
    import datetime as dt
    info = [("V1", "a", None, "P", "NON_GUARANTEED"), ("V2", "b", None, "P", "NON_GUARANTEED"),
            ("G1", "c", None, "P", "GUARANTEED"), ("N1", "d", None, "P", None)]
    var = [("V1", "3등급", "X", dt.date(2016, 1, 1), 100, 5.0, 5.0, 5.0, 0.5),
           ("V2", "3등급", "X", dt.date(2016, 1, 1), 100, 5.0, 5.0, 5.0, 0.5)]
    cat = _catalog(spark, var, [("G1", 12, 0.0)], info)
    users = spark.createDataFrame([survey_row(1, pension_operator=["A"])], SURVEY_DDL)
    from nestegg.operators.survey import build_profiles
    cands = with_stats(candidates(build_profiles(users), cat))
    g, v = split_category(cands)
    assert {r.product_id for r in cands.collect()} == {"V1", "V2", "G1", "N1"}
    assert g.count() == 1 and v.count() == 2          # the NULL category is in neither half
    comp = {r.product_id: r for r in variable_components(v, "2026-01-01").collect()}
    for r in comp.values():                            # all equal -> 50 everywhere; ties -> average rank
        assert r.norm_1y == r.norm_3y == r.norm_5y == 50.0 and r.score_c == 50.0
        assert r.score_a == 50.0 and r.score_s == 100.0   # exactly 10 years -> 100
    from nestegg.operators.guaranteed import guaranteed_components
    gr = guaranteed_components(g).first()
    assert gr.rate_level is None                        # max rate 0 -> NULL, not NaN
    stats = set_stats(cands).where("category = 'NON_GUARANTEED'").first()
    assert stats.n_worth == 2


def test_load_catalog_round_trip(spark):
    from nestegg.plans.queries import Context
    ctx = Context(spark, "/root/testdata/sf0.001")
    path = tempfile.mkdtemp(prefix="nestegg-cat-")
    for name, df in ctx.catalog.items():
        df.write.parquet(os.path.join(path, name))
    cat = load_catalog(spark, path, tables=list(ctx.catalog))
    assert cat["product_variable"].schema["average_return_7y"].dataType.simpleString() == "decimal(10,3)"
    assert cat["product_mapping"].count() == ctx.catalog["product_mapping"].count()


def test_apply_resolution(spark):
    users = spark.createDataFrame([survey_row(1, pension_operator=None), survey_row(2, pension_operator=None),
                                   survey_row(3, pension_operator=["old"])], SURVEY_DDL)
    typed = spark.createDataFrame([(1, " KB증권 "), (2, "KB증귄"), (3, "   ")], "user_id long, typed string")
    dim = spark.createDataFrame([("KB증권",), ("iM증권",)], "operator_name string")
    res = resolve_operators(typed, dim)
    choices = spark.createDataFrame([(2, "KB증권")], "user_id long, chosen string")
    got = {r.user_id: r.pension_operator for r in apply_resolution(users, res, choices).collect()}
    assert got == {1: ["KB증권"], 2: ["KB증권"], 3: ["old"]}


def test_append_turns_and_history(spark):
    hist = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "user", "q")],
                                 "conv_id long, turn long, role string, text string")
    new = spark.createDataFrame([(1, 1, "user", "q2"), (1, 2, "assistant", "a2"), (2, 1, "user", "first")],
                                "conv_id long, seq long, role string, text string")
    out = append_turns(hist, new)
    h = {r.conv_id: r for r in chat_history(out).collect()}
    assert [t.turn for t in h[1].turns] == [0, 1, 2, 3] and h[1].last_role == "assistant"
    assert [t.text for t in h[2].turns] == ["first"] and h[2].turns[0].turn == 0


def test_seed_reader_and_nested_sink(spark):
    from nestegg.sources.catalog import operator_names, read_seed
    from nestegg.sources.sinks import write_table
    d = tempfile.mkdtemp(prefix="nestegg-seed-")
    with open(os.path.join(d, "operator_info.csv"), "w", encoding="utf-8") as fh:
        fh.write("id,operator_name\nO999,정보없음\nO001,DB생명보험\n")
    ops = read_seed(spark, os.path.join(d, "operator_info.csv"), "operator_info")
    assert sorted(r.operator_name for r in operator_names(ops).collect()) == ["DB생명보험", "정보없음"]
    # The nested portfolio record survives a JSON and a Parquet round trip.
    from nestegg.plans.queries import Context
    p = Context(spark, "/root/testdata/sf0.001").portfolio
    for fmt in ("json", "parquet"):
        out = os.path.join(d, f"portfolio_{fmt}")
        write_table(p, out, fmt=fmt)
        back = spark.read.format(fmt).load(out)
        assert back.count() == p.count()
        assert set(back.columns) == set(p.columns)


def test_conversation_state_invalidates_suggestions(spark):
    from nestegg.operators.text import conversation_state
    msgs = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"),                      # answered: suggestions valid
         (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"),  # new user turn: invalid
         (3, 0, "system", "s")],                                              # nothing yet
        "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.suggestions_valid for r in conversation_state(msgs).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_latest_portfolio(spark):
    from nestegg.operators.portfolio import latest_portfolio
    hist = spark.createDataFrame([(1, 0, "a", ["x"]), (1, 3, "b", ["y", "z"]), (1, 2, "c", []), (2, 5, "d", ["w"])],
                                 "user_id long, turn long, risk string, items array<string>")
    got = {r.user_id: (r.turn, r.risk, list(r.items)) for r in latest_portfolio(hist).collect()}
    assert got == {1: (3, "b", ["y", "z"]), 2: (5, "d", ["w"])}
