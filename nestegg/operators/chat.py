"""Conversational turn and follow-up question prompts for many users at once.

Per turn: the user's portfolio (top-n, n = 5 in chat), the filtered retrieval
over the portfolio's products, the context layout by intent, and the rendered
messages. Retrieval is an equi-join of each query's candidate ids (at most 2n) with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestegg import constants as K
from nestegg.operators import retrieve as R
from nestegg.operators import text as T
from nestegg.operators.portfolio import SEGMENT_KEYS
from nestegg.session import bounded_broadcast, cut_lineage

# What the texts show of an item.
_SHOWN = ["product_id", "product_name", "score", "reasons"]


def _chatting(portfolio: DataFrame, turns: DataFrame) -> DataFrame:
    """Only the portfolios of users who have turns: texts are rendered for them alone."""
    return portfolio.join(turns.select("user_id").distinct(), "user_id", "left_semi")


def _contents(portfolio: DataFrame, turns: DataFrame, folder: str | None) -> tuple[DataFrame, DataFrame, int]:
    """The users who have turns with ``content_id`` instead of their items, the distinct contents, and the bytes of those.

    Items depend on the segment (and a silver user's period), so there are few contents however many users
    there are: they are written once, and no user or turn is shuffled with items or texts.
    """
    halves = ["guaranteed", "non_guaranteed"]
    shown = F.struct(*[F.transform(h, lambda x: F.struct(*[x[c] for c in _SHOWN])).alias(h) for h in halves])
    kind = portfolio.select(shown.alias("c")).schema["c"].dataType
    users = _chatting(portfolio, turns).withColumn("_json", F.to_json(shown)).withColumn("content_id", F.coalesce(F.sha2("_json", 256), F.lit("")))
    contents = users.select("content_id", "_json").distinct().withColumn("c", F.from_json("_json", kind.simpleString()))
    contents = contents.select("content_id", F.length("_json").alias("n_chars"), "c.*").withColumn("cand_ids", T.candidate_ids(T.all_items()))
    contents = cut_lineage(contents, "prompt_contents", folder)
    chars = contents.agg(F.sum("n_chars")).first()[0] or 0
    return users.drop("_json", *halves), contents.drop("n_chars"), 4 * chars


def portfolio_texts(portfolio: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Per user: portfolio context, reason block, candidate ids and names of all recommended items."""
    items = T.all_items()
    return portfolio.select(
        "user_id", "age", "period", "risk_preference", *(more or []),
        T.portfolio_context(portfolio).alias("portfolio_ctx"),
        T.reason_block(items).alias("reason_text"),
        T.candidate_ids(items).alias("cand_ids"),
        F.array_join(F.transform(items, lambda x: x["product_name"]), "\n").alias("product_text"),
        F.to_json(F.struct("user_id", "age", "period", "risk_preference", "summary")).alias("user_json"),
    )


def recommended_corpus(portfolio: DataFrame, docs: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Embedded documents of products recommended to someone (bounded by segments x 2n)."""
    ids = portfolio.select(F.explode(T.candidate_ids(T.all_items())).alias("product_id")).distinct()
    corpus = docs.join(ids, "product_id", "left_semi")
    # Rows hold an embedding and a document text (a few KB).
    return bounded_broadcast(corpus, max_rows, row_bytes=4096)


def _with_vectors(df: DataFrame, embedder) -> DataFrame:
    """``df`` with ``qvec``: by a function of the frame (precomputed vectors), else by a fitted embedder over ``query``."""
    return embedder(df) if callable(embedder) else R.embed(df, embedder, text_col="query", out="qvec")


def _corpus(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("product_id").alias("doc_id"), "embedding", "page_content")


def _outcome(known: Column) -> Column:
    return F.when(known, "answered").otherwise("no_profile")


def chat_prompts(turns: DataFrame, portfolio: DataFrame, docs: DataFrame, embedder, k: int = 3, folder: str | None = None) -> DataFrame:
    """(conv_id, turn, user_id, query) -> rendered [system, human] messages per turn.

    A turn of a user without a profile keeps its row: outcome ``no_profile``, NULL messages. Tables of the way
    (contents, recommended documents) are written in ``folder``, replacing those of an earlier call, else in fresh ones.
    """
    key = ["conv_id", "turn"]
    users, contents, size = _contents(portfolio, turns, folder)
    contents = bounded_broadcast(contents, known_rows=size, row_bytes=1)
    lists = contents.select("content_id", "cand_ids")
    recommended = lists.select(F.explode("cand_ids").alias("product_id")).distinct()
    # An id takes about 20 characters of a content, with its name, score and reasons 100 at least.
    corpus = docs.join(bounded_broadcast(recommended, known_rows=size, row_bytes=1), "product_id", "left_semi")
    corpus = cut_lineage(_corpus(corpus), "prompt_documents", folder)
    asked = _with_vectors(turns.join(users.select("user_id", "content_id"), "user_id"), embedder)
    queries = asked.select(*key, "qvec", "content_id").join(lists, "content_id").drop("content_id")
    hits = R.filtered_knn(queries, corpus, k, key, corpus_rows=corpus.count())
    rag = R.joined_texts(hits, key, "page_content", "\n\n", "rag_text")
    known = users.select("user_id", "age", "period", "risk_preference", "summary", "content_id", F.lit(True).alias("known"))
    out = turns.select(*key, "user_id", "query").join(known, "user_id", "left").join(rag, key, "left").join(contents, "content_id", "left")
    known = F.coalesce("known", F.lit(False))
    ctx = T.final_context(F.col("query"), T.portfolio_context(out), T.reason_block(T.all_items()), F.coalesce("rag_text", F.lit("")))
    messages = T.chat_messages(F.col("age"), F.col("risk_preference"), F.col("period"), F.col("query"), ctx)
    return out.select(*key, "user_id", "query", _outcome(known).alias("outcome"), F.when(known, messages).alias("messages"))


def question_prompts(portfolio: DataFrame, docs: DataFrame, embedder, k: int = 3) -> DataFrame:
    """Per user, the follow-up-question prompt (fixed query, product names, retrieved texts).

    The query is fixed and the candidates depend on the segment alone, so texts are retrieved
    once a segment; users only join the result.
    """
    # Distinct (segment, ids) are hash-aggregated: a minimum of arrays over the users would sort them with all their items.
    asked = portfolio.where(F.col("cand_key").isNotNull()).select(*SEGMENT_KEYS, T.candidate_ids(T.all_items()).alias("cand_ids")).distinct()
    segments = asked.groupBy(*SEGMENT_KEYS).agg(F.min("cand_ids").alias("cand_ids")).withColumn("query", F.lit(K.FOLLOWUP_QUERY))
    hits = R.filtered_knn(_with_vectors(segments, embedder).select(*SEGMENT_KEYS, "qvec", "cand_ids"), _corpus(docs), k, SEGMENT_KEYS)
    rag = R.joined_texts(hits, SEGMENT_KEYS, "page_content", "\n", "rag_text")
    texts = portfolio_texts(portfolio, ["is_silver", "manages_self", "cand_key"]).join(rag, SEGMENT_KEYS, "left")
    return texts.select("user_id", T.question_prompt(F.col("user_json"), F.col("product_text"),
                                                     F.coalesce("rag_text", F.lit(""))).alias("prompt"))


def advice_prompts(turns: DataFrame, portfolio: DataFrame) -> DataFrame:
    """(conv_id, turn, user_id, query) -> advice prompt over the user's portfolio context.

    A turn of a user without a profile keeps its row: outcome ``no_profile``, NULL prompt.
    """
    users, contents, size = _contents(portfolio, turns, None)
    known = users.select("user_id", "summary", "content_id", F.lit(True).alias("known"))
    out = turns.join(known, "user_id", "left").join(bounded_broadcast(contents, known_rows=size, row_bytes=1), "content_id", "left")
    context, known = T.portfolio_context(out), F.coalesce("known", F.lit(False))
    known = known & context.isNotNull()
    return out.select(
        "conv_id", "turn", "user_id", _outcome(known).alias("outcome"),
        F.when(known, T.advice_prompt(context, F.col("query"))).alias("prompt"))
