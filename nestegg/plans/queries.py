"""Registered queries: ``(spark, sf_dir) -> DataFrame`` with flat, aliased, rounded columns.

Every query reads the driver tables under ``sf_dir`` through the fixture adapter,
so its work grows with them. Shared intermediate plans (profiles, the checkpointed
candidate hub, the scored top-n) are built once per session and folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestegg.operators import guaranteed as G
from nestegg.operators.portfolio import Hub, Scored, portfolio_flat, recommend
from nestegg.operators.survey import (answer_texts, build_profiles, normalize_answers, survey_next_step,
                                      survey_options)
from nestegg.sources.fixtures import fixture

AS_OF = "2026-01-01"
TOP_N = 3
CHAT_TOP_N = 5

_CONTEXTS: dict = {}


class Context:
    """Lazily built shared plans for one (session, folder)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._fx: dict = {}
        self._scored: Scored | None = None
        self._portfolio: DataFrame | None = None

    def fx(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name, self._fx)

    def _bound_tasks(self) -> None:
        """The catalog's tables come from ``lineitem``, the largest table; it is counted once."""
        if not getattr(self, "_bounded", False):
            from nestegg.session import bound_tasks
            from nestegg.sources.tables import read_table
            bound_tasks(self.spark, read_table(self.spark, self.sf_dir, "lineitem").count())
            self._bounded = True

    @property
    def catalog(self) -> dict[str, DataFrame]:
        from nestegg.sources.fixtures import CATALOG_NAMES
        self._bound_tasks()
        return {k: self.fx(v) for k, v in CATALOG_NAMES.items()}

    @property
    def integrity_tables(self) -> dict[str, DataFrame]:
        from nestegg.sources.fixtures import INTEGRITY_NAMES
        self._bound_tasks()
        return {k: self.fx(v) for k, v in INTEGRITY_NAMES.items()}

    @property
    def dirty_tables(self) -> dict[str, DataFrame]:
        """The catalog with planted violations."""
        from nestegg.sources.fixtures import DIRTY_NAMES
        self._bound_tasks()
        return {k: self.fx(v) for k, v in DIRTY_NAMES.items()}

    @property
    def scored_nulls(self) -> Scored:
        """Top-n under the policy that keeps missing values."""
        if getattr(self, "_scored_nulls", None) is None:
            self._scored_nulls = Scored(self.profiles, self.catalog, AS_OF, top_n=TOP_N, missing="null")
        return self._scored_nulls

    @property
    def vector_documents(self) -> DataFrame:
        """Documents with precomputed vectors (rows of the embeddings)."""
        return self.documents.join(self.fx("fx_document_vectors"), "product_id").join(self.embeddings("embedding"), "vec_id")

    def embeddings(self, name: str) -> DataFrame:
        from nestegg.sources.tables import read_table
        return read_table(self.spark, self.sf_dir, "embeddings").select("vec_id", F.col("embedding").alias(name))

    @property
    def profiles(self) -> DataFrame:
        if getattr(self, "_profiles", None) is None:
            self._profiles = build_profiles(self.fx("fx_survey"))
        return self._profiles

    @property
    def hub(self) -> Hub:
        if getattr(self, "_hub", None) is None:
            self._hub = Hub(self.profiles, self.catalog, AS_OF)
        return self._hub

    @property
    def scored_chat(self) -> Scored:
        """Top-n of the chat (5); the portfolio's top-3 is derived from it."""
        if getattr(self, "_scored_chat", None) is None:
            self._scored_chat = Scored(self.profiles, top_n=max(CHAT_TOP_N, TOP_N), hub=self.hub)
        return self._scored_chat

    @property
    def scored(self) -> Scored:
        if self._scored is None:
            self._scored = Scored(self.profiles, top_n=TOP_N, base=self.scored_chat)
        return self._scored

    @property
    def portfolio(self) -> DataFrame:
        if self._portfolio is None:
            self._portfolio = recommend(self.scored)
        return self._portfolio

    @property
    def chat_portfolio(self) -> DataFrame:
        """Portfolios with the chat's top-n (5)."""
        if getattr(self, "_chat_portfolio", None) is None:
            chat = self.scored_chat if self.scored_chat.top_n == CHAT_TOP_N else Scored(
                self.profiles, top_n=CHAT_TOP_N, base=self.scored_chat)
            self._chat_portfolio = recommend(chat)
        return self._chat_portfolio

    @property
    def documents(self) -> DataFrame:
        from nestegg.operators.text import product_documents
        return product_documents(self.catalog, products_df=self.hub.products)

    @property
    def embedded_documents(self) -> DataFrame:
        if getattr(self, "_embedded", None) is None:
            from nestegg.operators.retrieve import build_vector_table
            docs = self.documents
            self._embedded, self.embedder = build_vector_table(docs)
        return self._embedded

    def user_turns(self) -> DataFrame:
        """User-role chat turns; conversation c belongs to user c."""
        from nestegg.sources.tables import read_table
        conv = read_table(self.spark, self.sf_dir, "conversations")
        return conv.where(F.col("role") == "user").select(
            "conv_id", "turn", F.col("conv_id").alias("user_id"), F.col("text").alias("query"))


def vectors_of(ctx: Context) -> Callable[[DataFrame], DataFrame]:
    """An embedder of turns that have precomputed vectors."""
    return lambda df: df.join(ctx.embeddings("qvec"), "vec_id")


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Context(spark, sf_dir)
    return _CONTEXTS[key]


def _r(c: str, d: int = 6):
    return F.round(F.col(c), d).alias(c)


# ---- B: survey and profile -------------------------------------------------------------

def q_risk_profile(spark, sf_dir):
    p = context(spark, sf_dir).profiles
    return p.select("user_id", "risk_score", "risk_preference", "grnt_ratio", "is_silver", "manages_self",
                    "cand_key")


def q_survey_next_step(spark, sf_dir):
    return survey_next_step(context(spark, sf_dir).fx("fx_survey_partial"))


def q_normalize_answers(spark, sf_dir):
    a = normalize_answers(context(spark, sf_dir).fx("fx_raw_answers"))
    return a.withColumn("pension_operator", F.array_join("pension_operator", ","))


def q_survey_answer_text(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return answer_texts(ctx.fx("fx_survey"), survey_options(spark)).select(
        "user_id", "step_key", "option_code", "option_text", "label")


def q_profile_defaults(spark, sf_dir):
    """B8, F6 on stored records: missing fields take the defaults, management styles are texts."""
    from nestegg.functions.scoring import tdf_fit_of_style
    from nestegg.operators.survey import with_profile_defaults
    r = with_profile_defaults(context(spark, sf_dir).fx("fx_profile_records"))
    return r.select("user_id", "risk_preference", "investment_amount", "period", "is_silver", "manages_self", "style", "grnt_ratio",
                    tdf_fit_of_style(F.col("style_text")).alias("tdf_fit"))


# ---- D: candidates ---------------------------------------------------------------------

def q_candidates(spark, sf_dir):
    hub = context(spark, sf_dir).hub
    c = hub.candidates.select("cand_key", "product_id").join(hub.products, "product_id")
    return c.select("cand_key", "product_id", "product_name", "product_type", "category", "maturity",
                    "interest_rate", "risk_level", "eligible_tdf",
                    F.col("launch_date").cast("string").alias("launch_date"), "total_net_worth",
                    "total_expense_ratio", "return_1y", "return_3y", "return_5y")


# ---- E: guaranteed ---------------------------------------------------------------------

def q_guaranteed_scores(spark, sf_dir):
    sc = context(spark, sf_dir).scored
    classes = sc.segments.select("cand_key", "risk_preference").distinct()
    s = G.score_for_class(sc.g_components.join(classes, "cand_key"))
    return s.select("cand_key", "risk_preference", "product_id", "is_safe", "is_risky", "product_score",
                    _r("rate_level"), _r("rate_score"), _r("score"))


def q_guaranteed_topn(spark, sf_dir):
    t = context(spark, sf_dir).scored.g_top
    return t.select("cand_key", "risk_preference", F.col("rank").cast("int").alias("rank"), "product_id",
                    _r("score"))


def q_guaranteed_reasons(spark, sf_dir):
    t = context(spark, sf_dir).scored.g_top
    return t.select("cand_key", "risk_preference", F.col("rank").cast("int").alias("rank"), "product_id",
                    F.array_join("reasons", " | ").alias("reasons"))


# ---- F: variable -----------------------------------------------------------------------

def q_variable_return_score(spark, sf_dir):
    v = context(spark, sf_dir).scored.v_components
    return v.select("cand_key", "product_id", _r("norm_1y"), _r("norm_3y"), _r("norm_5y"), _r("score_r"),
                    _r("score_r_silver"))


def q_variable_risk_score(spark, sf_dir):
    sc = context(spark, sf_dir).scored
    classes = sc.segments.select("cand_key", "risk_preference").distinct()
    v = sc.v_components.select("cand_key", "product_id", "parsed_risk").join(classes, "cand_key")
    from nestegg.functions.scoring import risk_level_score
    return v.select("cand_key", "risk_preference", "product_id", "parsed_risk",
                    risk_level_score(F.col("risk_preference"), F.col("parsed_risk")).alias("score_f"))


def q_variable_tdf_score(spark, sf_dir):
    sc = context(spark, sf_dir).scored
    flags = sc.segments.select("cand_key", "manages_self").distinct()
    v = sc.v_components.select("cand_key", "product_id", "product_tdf").join(flags, "cand_key")
    from nestegg.functions.scoring import tdf_fit
    return v.select("cand_key", "manages_self", "product_id", "product_tdf",
                    (F.col("product_tdf") * tdf_fit(F.col("manages_self"))).cast("double").alias("score_t"))


def q_variable_fee_score(spark, sf_dir):
    v = context(spark, sf_dir).scored.v_components
    return v.select("cand_key", "product_id", "total_expense_ratio", _r("score_c"))


def q_variable_size_score(spark, sf_dir):
    v = context(spark, sf_dir).scored.v_components
    return v.select("cand_key", "product_id", "total_net_worth", _r("score_a"))


def q_variable_age_score(spark, sf_dir):
    v = context(spark, sf_dir).scored.v_components
    return v.select("cand_key", "product_id", _r("years_active"), "score_s")


def q_variable_total_topn(spark, sf_dir):
    t = context(spark, sf_dir).scored.v_top
    return t.select("cand_key", "risk_preference", "is_silver", "manages_self",
                    F.col("rank").cast("int").alias("rank"), "product_id", _r("total_score"))


def q_variable_reasons(spark, sf_dir):
    t = context(spark, sf_dir).scored.v_top
    return t.select("cand_key", "risk_preference", "is_silver", "manages_self",
                    F.col("rank").cast("int").alias("rank"), "product_id",
                    F.array_join("reasons", " | ").alias("reasons"))


# ---- E, F with missing values kept ------------------------------------------------------

def q_null_return_score(spark, sf_dir):
    v = context(spark, sf_dir).scored_nulls.v_components
    return v.select("cand_key", "product_id", _r("norm_1y"), _r("norm_3y"), _r("norm_5y"), _r("score_r"),
                    _r("score_r_silver"))


def q_null_size_age_score(spark, sf_dir):
    v = context(spark, sf_dir).scored_nulls.v_components
    return v.select("cand_key", "product_id", "total_net_worth", _r("score_a"), _r("years_active"), "score_s")


def q_null_total_topn(spark, sf_dir):
    t = context(spark, sf_dir).scored_nulls.v_top
    return t.select("cand_key", "risk_preference", "is_silver", "manages_self",
                    F.col("rank").cast("int").alias("rank"), "product_id", _r("total_score"))


def q_null_guaranteed_topn(spark, sf_dir):
    t = context(spark, sf_dir).scored_nulls.g_top
    return t.select("cand_key", "risk_preference", F.col("rank").cast("int").alias("rank"), "product_id", _r("score"))


# ---- G: portfolio ----------------------------------------------------------------------

def q_portfolio_flat(spark, sf_dir):
    return portfolio_flat(context(spark, sf_dir).portfolio)


def q_portfolio_summary(spark, sf_dir):
    p = context(spark, sf_dir).portfolio
    return p.select(
        "user_id", F.col("summary.risk_preference").alias("risk_preference"),
        F.col("summary.total_amt").alias("total_amt"), F.col("summary.grnt_ratio").alias("grnt_ratio"),
        F.round(F.col("summary.ungrnt_ratio"), 6).alias("ungrnt_ratio"),
        F.size("guaranteed").cast("long").alias("n_guaranteed"),
        F.size("non_guaranteed").cast("long").alias("n_non_guaranteed"),
    )


# ---- A3 / C: catalog integrity and operator resolution ----------------------------------

def q_catalog_integrity(spark, sf_dir):
    from nestegg.operators.integrity import integrity_report
    return integrity_report(context(spark, sf_dir).integrity_tables)


def q_catalog_violations(spark, sf_dir):
    """The report over a catalog with planted violations of every kind of rule."""
    from nestegg.operators.integrity import integrity_report
    return integrity_report(context(spark, sf_dir).dirty_tables)


def q_rejected_rows(spark, sf_dir):
    """A3 before the write, D7: rejected rows of a table that arrives as text, with rule, column and raw value."""
    from nestegg.operators.integrity import checked_rows, rejected_rows
    ctx = context(spark, sf_dir)
    rows = checked_rows("product_fixed", ctx.fx("fx_raw_product_fixed"), {"product_info": ctx.fx("fx_product_info")})
    return rejected_rows("product_fixed", rows)


#: Operator names as a user may type them into a query's list.
ASKED_OPERATORS = ["OP1", "OP2", "OP1", "O'P3'); DROP TABLE x; --", "\\", ":names", ""]


def q_products_by_names(spark, sf_dir):
    """A1, A2: the catalog query with its list of names as a bound parameter."""
    from nestegg.sources.catalog import run_query
    ctx = context(spark, sf_dir)
    return run_query(spark, """
        SELECT DISTINCT i.id AS product_id, i.product_name, i.category, CAST(f.interest_rate AS DOUBLE) AS interest_rate
        FROM {operators} o JOIN {mapping} m ON m.operator_id = o.id JOIN {info} i ON i.id = m.product_id LEFT JOIN {fixed} f ON f.id = i.id
        WHERE o.operator_name IN (:names) AND i.category = :category""",
        {"names": ASKED_OPERATORS, "category": "GUARANTEED"},
        {"operators": ctx.fx("fx_operator_info"), "mapping": ctx.fx("fx_product_mapping"), "info": ctx.fx("fx_product_info"),
         "fixed": ctx.fx("fx_product_fixed")})


def q_operator_exact(spark, sf_dir):
    """C1, C3 against the operator table: blank and exact names; the other texts are left to the fuzzy match."""
    from nestegg.operators.resolve import resolve_operators
    ctx = context(spark, sf_dir)
    r = resolve_operators(ctx.fx("fx_operator_typed_info"), ctx.fx("fx_operator_info"))
    outcome = F.when(F.col("outcome").isin("blank", "exact"), F.col("outcome")).otherwise("fuzzy")
    return r.select("user_id", "typed", outcome.alias("outcome"), "matched")


def q_operator_fuzzy_pairs(spark, sf_dir):
    """The (typed, name) pairs that the bounds leave for the exact ratio."""
    from nestegg.functions.common import py_strip
    from nestegg.operators.resolve import fuzzy_pairs
    ctx = context(spark, sf_dir)
    typed = ctx.fx("fx_operator_typed_info").select(py_strip(F.col("typed")).alias("typed")).where(F.col("typed") != "")
    return fuzzy_pairs(typed, ctx.fx("fx_operator_info")).select("typed", "name", "common")


def q_operator_resolution(spark, sf_dir):
    from nestegg.operators.resolve import resolve_operators
    ctx = context(spark, sf_dir)
    r = resolve_operators(ctx.fx("fx_operator_typed"), ctx.fx("fx_operator_names"))
    return r.select("user_id", "raw", "typed", "outcome", "matched",
                    F.array_join("suggestions", "|").alias("suggestions"))


def q_operator_suggestions(spark, sf_dir):
    """C2 against the operator table: the similar names of every text that is no name itself."""
    from nestegg.functions.common import py_strip
    from nestegg.operators.resolve import fuzzy_matches
    ctx = context(spark, sf_dir)
    names = ctx.fx("fx_operator_info")
    typed = ctx.fx("fx_operator_typed_info").select(py_strip(F.col("typed")).alias("typed"))
    typed = typed.join(names.select(F.col("operator_name").alias("typed")), "typed", "left_anti")
    return fuzzy_matches(typed, names).select("typed", F.col("rank").cast("int").alias("rank"), "name", _r("ratio", 9))


def q_display_rounding(spark, sf_dir):
    """G4 on numbers that are half-way between two tenths, and on prices."""
    from nestegg.functions.common import python_round1
    from nestegg.sources.tables import read_table
    part = read_table(spark, sf_dir, "part")
    halves = part.select("p_partkey", ((F.col("p_partkey") % 4001).cast("double") / 20.0).alias("x"))
    rows = halves.unionByName(part.select("p_partkey", (F.col("p_retailprice").cast("double") / 8).alias("x")))
    return rows.withColumn("shown", python_round1(F.col("x")))


# ---- H: documents, contexts, retrieval, prompts ------------------------------------------

def q_rag_documents(spark, sf_dir):
    return context(spark, sf_dir).documents


def q_portfolio_context(spark, sf_dir):
    from nestegg.operators import text as T
    p = context(spark, sf_dir).portfolio
    items = T.all_items()
    return p.select("user_id", T.portfolio_context(p).alias("context"), T.reason_block(items).alias("reason_text"),
                    F.array_join(T.candidate_ids(items), ",").alias("candidate_ids"),
                    T.list_context(items).alias("list_context"),
                    T.comparison_context(items).alias("comparison_context"))


def q_intent(spark, sf_dir):
    from nestegg.operators import text as T
    from nestegg.sources.tables import read_table
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return conv.select("conv_id", "turn", T.intent(F.col("text")).alias("intent"),
                       T.is_recommendation(F.col("text")).alias("is_recommendation"))


def q_turn_intent(spark, sf_dir):
    """H6, H7 over turns with planted comparison words and request literals."""
    from nestegg.operators import text as T
    return context(spark, sf_dir).fx("fx_turns").select(
        "conv_id", "turn", T.intent("query").alias("intent"), T.is_recommendation("query").alias("is_recommendation"))


def q_filtered_knn(spark, sf_dir):
    """Every vector is a query; its candidate list is the next 2n (= 10) ids, as a portfolio's 2n products."""
    from nestegg.operators.retrieve import filtered_knn
    from nestegg.sources.tables import read_table
    e = read_table(spark, sf_dir, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"),
                 F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 2 * CHAT_TOP_N).alias("cand_ids"))
    corpus = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    hits = filtered_knn(q, corpus, 3, ["query_id"], "doc_id")
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias("neighbor_id"),
                       F.round("distance", 6).alias("distance"))


def q_filtered_knn_fetch(spark, sf_dir):
    """H10 with ``fetch_k``: of the 50 nearest vectors, the 3 nearest among the query's candidates (ids of its own parity)."""
    from nestegg.operators.retrieve import filtered_knn
    from nestegg.sources.tables import read_table
    e = read_table(spark, sf_dir, "embeddings")
    listed = F.filter(F.sequence(F.col("vec_id") - 40, F.col("vec_id") + 40), lambda i: (i - F.col("vec_id")) % 2 == 0)
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), listed.alias("cand_ids"))
    hits = filtered_knn(q, e.select(F.col("vec_id").alias("doc_id"), "embedding"), 3, ["query_id"], "doc_id", fetch_k=50)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias("neighbor_id"),
                       F.round("distance", 6).alias("distance"))


def q_parse_questions(spark, sf_dir):
    from nestegg.operators.text import parse_questions
    from nestegg.sources.tables import read_table
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return conv.select("conv_id", "turn", F.posexplode(parse_questions(F.col("text"))).alias("pos", "question")) \
        .select("conv_id", "turn", (F.col("pos") + 1).cast("int").alias("q_idx"), "question")


def q_chat_history(spark, sf_dir):
    from nestegg.sources.tables import read_table
    from nestegg.operators.text import conversation_state
    return conversation_state(read_table(spark, sf_dir, "conversations"))


def q_advice_prompts(spark, sf_dir):
    from nestegg.operators.chat import advice_prompts
    ctx = context(spark, sf_dir)
    return advice_prompts(ctx.fx("fx_turns"), ctx.portfolio)


def q_chat_prompts(spark, sf_dir):
    from nestegg.operators.chat import chat_prompts
    ctx = context(spark, sf_dir)
    docs = ctx.embedded_documents
    out = chat_prompts(ctx.user_turns(), ctx.chat_portfolio, docs, ctx.embedder)
    return _prompt_columns(out)


def _prompt_columns(prompts: DataFrame) -> DataFrame:
    return prompts.select("conv_id", "turn", "user_id", "outcome", F.col("messages")[0]["content"].alias("system_prompt"),
                          F.col("messages")[1]["content"].alias("human_prompt"))


def q_chat_prompts_vectors(spark, sf_dir):
    """H18 with precomputed vectors, over turns of all kinds (planted words, users without a profile)."""
    from nestegg.operators.chat import chat_prompts
    ctx = context(spark, sf_dir)
    turns = ctx.fx("fx_turns")
    return _prompt_columns(chat_prompts(turns, ctx.chat_portfolio, ctx.vector_documents, vectors_of(ctx)))


def q_chat_prompts_stream(spark, sf_dir):
    """H18 as a stream: the turns are written to a folder, streamed from there, and answered batch by batch."""
    from nestegg.streaming.conversations import batches, run_prompts
    from nestegg.session import shared_path
    ctx, folder = context(spark, sf_dir), shared_path(spark, "prompt_stream")
    ctx.fx("fx_turns").write.parquet(f"{folder}/turns")
    turns = spark.readStream.schema(ctx.fx("fx_turns").schema).parquet(f"{folder}/turns")
    run_prompts(turns, lambda _: ctx.chat_portfolio, ctx.vector_documents, vectors_of(ctx), f"{folder}/prompts",
                f"{folder}/checkpoint").awaitTermination()
    message = "messages array<struct<role: string, content: string>>"
    return _prompt_columns(batches(spark, f"{folder}/prompts", f"conv_id long, turn long, user_id long, query string, outcome string, {message}"))


def q_chat_history_stream(spark, sf_dir):
    """H17 as a stream over the conversations (written to a folder first); turns are a second apart."""
    from nestegg.streaming.conversations import current_states, run_states
    from nestegg.session import shared_path
    from nestegg.sources.tables import read_table
    folder, source = shared_path(spark, "history_stream"), read_table(spark, sf_dir, "conversations")
    source.write.parquet(f"{folder}/turns")  # a file source needs a folder
    turns = spark.readStream.schema(source.schema).parquet(f"{folder}/turns")
    turns = turns.withColumn("event_time", F.timestamp_seconds(F.lit(1767225600) + F.col("turn")))
    run_states(turns, f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    return current_states(spark, f"{folder}/states")


def q_question_prompts_vectors(spark, sf_dir):
    """H14 with precomputed vectors: the query's vector is row 0 of the embeddings."""
    from nestegg.operators.chat import question_prompts
    ctx = context(spark, sf_dir)
    vectors = lambda df: df.withColumn("vec_id", F.lit(0).cast("long")).join(ctx.embeddings("qvec"), "vec_id")
    return question_prompts(ctx.chat_portfolio, ctx.vector_documents, vectors)


def q_appended_turns(spark, sf_dir):
    """Every conversation's turns, followed by one more user turn and its answer."""
    from nestegg.operators.text import append_turns
    from nestegg.sources.tables import read_table
    history = read_table(spark, sf_dir, "conversations")
    added = history.where((F.col("turn") == 0)).select(
        "conv_id", F.inline(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(role).alias("role"), F.col("text").alias("text"))
                                      for i, role in enumerate(["user", "assistant"])])))
    return append_turns(history, added)


def q_latest_portfolio(spark, sf_dir):
    """Of the portfolios a user got at each turn, the latest (the amount tells the turns apart)."""
    from nestegg.operators.portfolio import latest_portfolio
    ctx = context(spark, sf_dir)
    p = ctx.portfolio.select("user_id", "risk_preference", F.col("summary.total_amt").alias("amount"))
    history = ctx.user_turns().select("user_id", "turn").join(p, "user_id").withColumn("amount", F.col("amount") + F.col("turn"))
    return latest_portfolio(history).select("user_id", "turn", "risk_preference", "amount")


def q_question_prompts(spark, sf_dir):
    from nestegg.operators.chat import question_prompts
    ctx = context(spark, sf_dir)
    docs = ctx.embedded_documents
    return question_prompts(ctx.chat_portfolio, docs, ctx.embedder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "risk_profile": q_risk_profile,
    "survey_next_step": q_survey_next_step,
    "normalize_answers": q_normalize_answers,
    "survey_answer_text": q_survey_answer_text,
    "candidates": q_candidates,
    "guaranteed_scores": q_guaranteed_scores,
    "guaranteed_topn": q_guaranteed_topn,
    "guaranteed_reasons": q_guaranteed_reasons,
    "variable_return_score": q_variable_return_score,
    "variable_risk_score": q_variable_risk_score,
    "variable_tdf_score": q_variable_tdf_score,
    "variable_fee_score": q_variable_fee_score,
    "variable_size_score": q_variable_size_score,
    "variable_age_score": q_variable_age_score,
    "variable_total_topn": q_variable_total_topn,
    "variable_reasons": q_variable_reasons,
    "portfolio_flat": q_portfolio_flat,
    "portfolio_summary": q_portfolio_summary,
    "catalog_integrity": q_catalog_integrity,
    "operator_resolution": q_operator_resolution,
    "rag_documents": q_rag_documents,
    "portfolio_context": q_portfolio_context,
    "intent": q_intent,
    "filtered_knn": q_filtered_knn,
    "parse_questions": q_parse_questions,
    "chat_history": q_chat_history,
    "advice_prompts": q_advice_prompts,
    "chat_prompts": q_chat_prompts,
    "question_prompts": q_question_prompts,
    "catalog_violations": q_catalog_violations,
    "operator_exact": q_operator_exact,
    "operator_fuzzy_pairs": q_operator_fuzzy_pairs,
    "null_return_score": q_null_return_score,
    "null_size_age_score": q_null_size_age_score,
    "null_total_topn": q_null_total_topn,
    "null_guaranteed_topn": q_null_guaranteed_topn,
    "turn_intent": q_turn_intent,
    "chat_prompts_vectors": q_chat_prompts_vectors,
    "question_prompts_vectors": q_question_prompts_vectors,
    "appended_turns": q_appended_turns,
    "latest_portfolio": q_latest_portfolio,
    "operator_suggestions": q_operator_suggestions,
    "display_rounding": q_display_rounding,
    "profile_defaults": q_profile_defaults,
    "rejected_rows": q_rejected_rows,
    "products_by_names": q_products_by_names,
    "filtered_knn_fetch": q_filtered_knn_fetch,
    "chat_history_stream": q_chat_history_stream,
    "chat_prompts_stream": q_chat_prompts_stream,
}
