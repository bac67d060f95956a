"""Segments of the follow-up questions: no sort of users with their items."""

import re

from pyspark.sql import functions as F

from nestegg.operators.chat import advice_prompts, chat_prompts, question_prompts

ITEM = "struct<rank int, product_id string, product_name string, score double, reasons array<string>, pad string>"
DDL = (f"user_id long, age int, period int, risk_preference string, is_silver boolean, manages_self boolean, cand_key string, "
       f"summary struct<risk_preference: string, total_amt: long, grnt_ratio: double, ungrnt_ratio: double>, guaranteed array<{ITEM}>, non_guaranteed array<{ITEM}>")


def test_users_are_not_sorted_with_their_items_for_the_segments(spark):
    item = lambda p: (1, p, f"name {p}", 1.0, ["r"], "x" * 50)
    users = [(u, 30, 4, "r", True, False, key, ("r", 5, 0.5, 0.5), [item(a)], [item("c")])
             for u, key, a in [(1, "k", "a"), (2, "k", "a"), (3, "m", "b"), (4, "m", "a"), (5, None, "b")]]
    docs = spark.createDataFrame([(p, [float(i)], f"text {p}") for i, p in enumerate("abc")], "product_id string, embedding array<double>, page_content string")
    vectors = lambda df: df.withColumn("qvec", F.array(F.lit(0.0)))
    out = question_prompts(spark.createDataFrame(users, DDL), docs, vectors, k=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortAggregate\(.*partial_min\((concat|transform)", plan)
    # "m" has two lists: the least is asked for, which holds the text nearest to the vector.
    found = {r.user_id: [p for p in "abc" if f"text {p}" in r.prompt] for r in out.collect()}
    assert found == {1: ["a"], 2: ["a"], 3: ["a"], 4: ["a"], 5: []}


def asked(spark):
    item = lambda p: (1, p, f"name {p}", 1.0, ["r"], "x" * 50)
    users = [(u, 30, 4, "r", True, False, "k", ("r", 5, 0.5, 0.5), [item("a")], [item("c")]) for u in (1, 1, 2, 3)]
    turns = [(10, 0, 1, "q"), (11, 0, 2, "q"), (11, 0, 2, "q"), (12, None, 2, "q"), (13, 0, 9, "q"), (14, 0, None, "q")]
    docs = [(p, [float(i)], f"text {p}") for i, p in enumerate("abc")] + [("c", [2.0], "more c")]
    return (spark.createDataFrame(turns, "conv_id long, turn long, user_id long, query string"), spark.createDataFrame(users, DDL),
            spark.createDataFrame(docs, "product_id string, embedding array<double>, page_content string"))


def shuffled_columns(df):
    """The columns that come to each shuffle of the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning" in line]


def test_turns_and_users_are_not_shuffled_with_texts(spark):
    turns, portfolio, docs = asked(spark)
    vectors = lambda df: df.withColumn("qvec", F.array(F.lit(0.0)))
    for out in (chat_prompts(turns, portfolio, docs, vectors), advice_prompts(turns, portfolio)):
        below = shuffled_columns(out)
        assert below and not any(re.search("portfolio_ctx|reason_text|format_string", x) for x in below)
    # Ranked pairs carry no text of the documents to their shuffle.
    plan = chat_prompts(turns, portfolio, docs, vectors)._jdf.queryExecution().optimizedPlan().toString()
    pairs = next(x for x in plan.splitlines() if "AS distance#" in x)
    assert "page_content" not in pairs and "embedding#" not in pairs.split("AS distance#")[1]


def test_prompts_of_doubled_users_turns_and_documents(spark):
    turns, portfolio, docs = asked(spark)
    vectors = lambda df: df.withColumn("qvec", F.array(F.lit(2.0)))
    rows = sorted(chat_prompts(turns, portfolio, docs, vectors).collect(), key=str)
    texts = {(r.conv_id, r.turn): re.findall(r"text [abc]|more c", r.messages[1].content) if r.messages else None for r in rows}
    # Pairs of doubled rows are ranked together: the nearest document is "c", of which there are two rows.
    assert {k: len(v) if v else v for k, v in texts.items()} == {(10, 0): 3, (11, 0): 3, (12, None): [], (13, 0): None, (14, 0): None}
    assert set(texts[10, 0]) == {"text c", "more c"}
    assert [r.conv_id for r in rows].count(10) == 2 and [r.conv_id for r in rows].count(11) == 2
    assert {r.conv_id: r.outcome for r in rows} == {10: "answered", 11: "answered", 12: "answered", 13: "no_profile", 14: "no_profile"}
    told = advice_prompts(turns, portfolio).collect()
    assert len(told) == 7 and all(("name a" in (r.prompt or "")) == (r.outcome == "answered") for r in told)
