"""Text tables: product documents, portfolio contexts, intents, prompts, parsed answers.

Every function is a column expression over one row (arrays of at most 2n items
are walked with ``transform``); nothing is collected to the driver.
Number formats are fixed rather than inherited from pandas printing: months
and net worth as integers, rates with their storage scale, allocation percents
with two decimals, display scores as ``round(x, 1)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestegg import constants as K
from nestegg.functions.common import py_strip
from nestegg.operators.candidates import coerce, products


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fmt_dec(c: Column, scale: int) -> Column:
    return c.cast(f"decimal(18,{scale})").cast("string")


def _shown(c: Column, missing: str) -> Column:
    """A value as printed in a document; a missing value is the fill (zero) or 'None'."""
    return F.coalesce(c, F.lit("0" if missing == "zero" else "None"))


def product_documents(catalog: dict[str, DataFrame] | None, missing: str = "zero",
                      products_df: DataFrame | None = None) -> DataFrame:
    """H1: one document per guaranteed / variable product: (product_id, category, page_content).

    ``products_df`` may pass an already coerced product table (e.g. a materialised one).
    """
    p = products_df if products_df is not None else coerce(products(catalog), missing)
    p = p.where(F.col("category").isin("GUARANTEED", "NON_GUARANTEED"))
    g = F.col("category") == "GUARANTEED"
    header = F.format_string(K.DOC_HEADER, F.col("product_name"), _shown(F.col("product_type"), missing),
                             F.when(g, K.DOC_KIND_GUARANTEED).otherwise(K.DOC_KIND_VARIABLE))
    fixed = F.format_string(K.DOC_GUARANTEED,
                            _shown(F.col("maturity").cast("long").cast("string"), missing),
                            _shown(_fmt_dec(F.col("interest_rate"), 2), missing))
    variable = F.format_string(
        K.DOC_VARIABLE,
        _shown(F.col("risk_level"), missing),
        F.when(F.col("eligible_tdf") == "O", K.DOC_TDF_IN).otherwise(K.DOC_TDF_OUT),
        _shown(F.col("launch_date").cast("string"), missing),
        _shown(F.col("total_net_worth").cast("long").cast("string"), missing),
        _shown(_fmt_dec(F.col("total_expense_ratio"), 3), missing),
        _shown(_fmt_dec(F.col("return_1y"), 3), missing),
        _shown(_fmt_dec(F.col("return_3y"), 3), missing),
        _shown(_fmt_dec(F.col("return_5y"), 3), missing),
    )
    content = F.concat(header, F.when(g, fixed).otherwise(variable))
    return p.select("product_id", "category", py_strip(content).alias("page_content"))


def _score_text(x: Column) -> Column:
    return x.cast("string")


def _numbered(items: Column, sep: str) -> Column:
    """"{i}위. name (점수: s점) - 특징: r1, r2\n" for each item, in array order."""
    return F.array_join(F.transform(items, lambda x, i: F.format_string(
        K.CTX_ITEM, (i + 1).cast("string"), x["product_name"], _score_text(x["score"]),
        F.array_join(x["reasons"], sep))), "")


def portfolio_context(portfolio: DataFrame) -> Column:
    """H2: the summary and both numbered lists as one text (per user)."""
    s = F.col("summary")
    head = F.format_string(
        K.CTX_SUMMARY, s["risk_preference"], F.format_string("%,d", s["total_amt"]),
        F.format_string("%.2f", s["grnt_ratio"] * 100), F.format_string("%.2f", s["ungrnt_ratio"] * 100))
    return F.concat(head, F.lit(K.CTX_GUARANTEED_HEAD), _numbered(F.col("guaranteed"), ", "),
                    F.lit(K.CTX_VARIABLE_HEAD), _numbered(F.col("non_guaranteed"), ", "))


def all_items(portfolio_cols=("guaranteed", "non_guaranteed")) -> Column:
    """Both halves in order: guaranteed first."""
    return F.concat(*[F.col(c) for c in portfolio_cols])


def reason_block(items: Column) -> Column:
    """H3: "[시스템 추천 사유]" + one block per recommended product."""
    return F.concat(F.lit(K.REASON_BLOCK_HEAD), F.array_join(F.transform(items, lambda x: F.format_string(
        K.REASON_BLOCK_ITEM, x["product_name"], _score_text(x["score"]), F.array_join(x["reasons"], "\n  - "))), ""))


def candidate_ids(items: Column) -> Column:
    """H8: product ids of all recommended items (guaranteed first)."""
    return F.transform(items, lambda x: x["product_id"])


def list_context(items: Column) -> Column:
    """H4: name / rate / risk / reasons per item (rate: interest rate, risk: risk level)."""
    return F.array_join(F.transform(items, lambda x: F.format_string(
        K.LIST_CONTEXT_ITEM, x["product_name"], F.coalesce(x["product_info"]["interest_rate"].cast("string"), F.lit("None")),
        F.coalesce(x["product_info"]["risk_level"], F.lit("None")), F.array_join(x["reasons"], "; "))), "")


def comparison_context(items: Column) -> Column:
    """H5: like H4 with a percent sign on the rate and ', ' between features."""
    return F.array_join(F.transform(items, lambda x: F.format_string(
        K.COMPARISON_CONTEXT_ITEM, x["product_name"],
        F.coalesce(x["product_info"]["interest_rate"].cast("string"), F.lit("None")),
        F.coalesce(x["product_info"]["risk_level"], F.lit("None")), F.array_join(x["reasons"], ", "))), "")


def intent(text: Column) -> Column:
    """H6: 'compare' when the text mentions a comparison word, else 'recommend'."""
    text = _c(text)
    cond = F.lit(False)
    for w in K.COMPARE_WORDS:
        cond = cond | F.coalesce(text.contains(w), F.lit(False))
    return F.when(cond, "compare").otherwise("recommend")


def is_recommendation(text: Column) -> Column:
    """H7: the stripped text is one of the recommendation-request literals."""
    text = _c(text)
    return F.coalesce(py_strip(text).isin(*K.RECOMMEND_REQUESTS), F.lit(False))


def final_context(query: Column, portfolio_ctx: Column, reasons: Column, rag_text: Column) -> Column:
    """Recommendation layout or question layout of the prompt context."""
    return F.when(is_recommendation(query), F.format_string(K.CONTEXT_RECOMMEND, portfolio_ctx, rag_text)) \
        .otherwise(F.format_string(K.CONTEXT_QUESTION, portfolio_ctx, reasons, rag_text))


def chat_messages(age: Column, risk: Column, period: Column, query: Column, context: Column) -> Column:
    """[system, human] messages as array<struct<role, content>>."""
    human = F.format_string(K.CHAT_HUMAN, age.cast("string"), risk, period.cast("string"), query, context)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(K.CHAT_SYSTEM).alias("content")),
                   F.struct(F.lit("human").alias("role"), human.alias("content")))


def advice_prompt(portfolio_ctx: Column, query: Column) -> Column:
    """The single-text advice prompt (the text itself is the result)."""
    return F.format_string(K.ADVICE_PROMPT, portfolio_ctx, query)


def question_prompt(user_json: Column, names: Column, rag_text: Column) -> Column:
    """Follow-up-question prompt; the user record is rendered as JSON."""
    return F.format_string(K.QUESTION_PROMPT, user_json, names, rag_text)


def parse_questions(response: Column) -> Column:
    """Split on newlines, keep lines longer than 5 (before stripping), strip, first 3."""
    lines = F.filter(F.split(_c(response), "\n"), lambda s: F.length(s) > K.QUESTION_MIN_LEN)
    return F.slice(F.transform(lines, lambda s: py_strip(s)), 1, K.QUESTION_COUNT)


def chat_history(messages: DataFrame) -> DataFrame:
    """Per conversation, the ordered turns and the latest role.

    ``messages`` is (conv_id, turn, role, text). Turns are ordered inside each
    conversation's array; a conversation is one group of bounded size (one chat).
    """
    return (messages.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"),
                 F.max_by("role", "turn").alias("last_role"),
                 F.count(F.lit(1)).alias("n_turns")))


def conversation_state(messages: DataFrame) -> DataFrame:
    """H17 as aggregates per conversation (partial aggregation, no collection of turns).

    Suggested follow-up questions are produced after an assistant answer and are
    invalidated by the next user turn: they are valid while the latest assistant
    turn comes after the latest user turn.
    """
    user_turn = F.max(F.when(F.col("role") == "user", F.col("turn")))
    assistant_turn = F.max(F.when(F.col("role") == "assistant", F.col("turn")))
    return (messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).cast("long").alias("n_user"),
        F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).cast("long").alias("n_assistant"),
        F.max_by("role", "turn").alias("last_role"),
        user_turn.alias("last_user_turn"),
        assistant_turn.alias("last_assistant_turn"),
        F.sum(F.length("text")).cast("long").alias("history_chars"),
    ).withColumn("suggestions_valid",
                 F.coalesce(F.col("last_assistant_turn") > F.coalesce(F.col("last_user_turn"), F.lit(-1)),
                            F.lit(False))))


def append_turns(history: DataFrame, new_turns: DataFrame) -> DataFrame:
    """Append (conv_id, role, text) rows after the current last turn, in input order ``seq``."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    w = Window.partitionBy("conv_id").orderBy("seq")
    added = (new_turns.join(last, "conv_id", "left")
             .withColumn("turn", F.coalesce(F.col("_last"), F.lit(-1)) + F.row_number().over(w))
             .select("conv_id", "turn", "role", "text"))
    return history.select("conv_id", "turn", "role", "text").unionByName(added)
