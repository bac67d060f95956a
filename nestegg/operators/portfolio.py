"""Portfolio assembly (G1-G4): segments -> top-n -> per-user nested record.

Items are assembled once per segment into small arrays; users then join those
arrays (size-checked broadcast), so the user table is never shuffled and never
multiplied by the product count.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestegg.functions.common import python_round1
from nestegg.operators import bitmaps as B
from nestegg.operators import guaranteed as G
from nestegg.operators import variable as V
from nestegg.operators.candidates import candidate_sets, product_table, set_operators, with_stats
from nestegg.session import bounded_broadcast, cut_lineage

GUARANTEED_KEYS = ["cand_key", "risk_preference"]
SEGMENT_KEYS = ["cand_key", "risk_preference", "is_silver", "manages_self"]

# The product record carried by every item (the 14 catalog columns), same for both halves.
PRODUCT_INFO = ["product_id", "product_name", "product_type", "category", "maturity", "interest_rate",
                "risk_level", "eligible_tdf", "launch_date", "total_net_worth", "total_expense_ratio",
                "return_1y", "return_3y", "return_5y"]
# Columns kept from the component tables (keys, scores, and the raw values the score queries show).
G_COMPONENT_COLS = ["cand_key", "product_id", "category", "interest_rate", "is_safe", "is_risky", "kind", "rate_level"]
V_COMPONENT_COLS = ["cand_key", "product_id", "category", "total_net_worth", "total_expense_ratio", "parsed_risk",
                    "product_tdf", "years_active", "score_s", "norm_1y", "norm_3y", "norm_5y", "score_r",
                    "score_r_silver", "score_c", "score_a"]
# Component scores per half, carried as a map so both halves share one item type.
_G_SCORES = ["product_score", "rate_level", "rate_score", "score"]
_V_SCORES = ["norm_1y", "norm_3y", "norm_5y", "score_r_mode", "parsed_risk", "score_f", "product_tdf", "score_t",
             "score_c", "score_a", "years_active", "score_s", "total_score"]


def segments(profiles: DataFrame) -> DataFrame:
    """Distinct scoring segments among users (bounded by candidate sets x 5 x 2 x 2)."""
    return profiles.where(F.col("cand_key").isNotNull()).select(*SEGMENT_KEYS).distinct()


class Hub:
    """Candidate rows and their segment-free components, shared by every top-n.

    Product-level features (keyword kind, parsed risk level, TDF flag, launch age) are computed once
    per product. A candidate set is the union of its operators' bitmaps, its statistics merge from
    its operators' extremes, and the size rank counts bits (``bitmaps.py``): what is written grows
    with operators x products. Rows of (set, product) are expanded where they are consumed (the
    top-n, or a query that returns them) and never shuffled, and product texts are
    attached to the bounded top-n rows only. The candidate-set table is the only one whose size is
    measured: every table keyed by candidate set is bounded by a fixed multiple of it (classes x
    silver x direct <= 20).
    """

    def __init__(self, profiles: DataFrame, catalog: dict[str, DataFrame], as_of: str, missing: str = "zero",
                 materialize: bool = True, bucket_bits: int = B.BUCKET_BITS):
        self.profiles = profiles
        self.as_of = as_of
        self.missing = missing
        self.materialize = materialize
        self.segments = segments(profiles)
        self.cand_sets = cut_lineage(candidate_sets(profiles), "candidate_sets")
        self.set_rows = self.cand_sets.count()
        # Catalog-sized, read by the features, the top-n texts and the documents: written once.
        self.products = self.keep(product_table(catalog, missing), "products")
        feats = V.variable_features(G.guaranteed_features(self.products), as_of, missing).select(
            "product_id", "category", "interest_rate", "return_1y", "return_3y", "return_5y", "total_expense_ratio",
            "total_net_worth", "is_safe", "is_risky", "kind", "parsed_risk", "product_tdf", "years_active", "score_s")
        self.slots = B.product_slots(feats, bucket_bits=bucket_bits)
        self.operators = set_operators(self.cand_sets, catalog)
        self.summaries = self.keep(B.operator_summaries(catalog["product_mapping"], self.slots.rows), "operator_summaries")
        self.counts = self.keep(B.ranked_counts(self.sets, self.slots), "set_counts")
        self.edges = self.keep(B.word_edges(self.slots), "slot_edges")
        worth = self.counts.groupBy("cand_key").agg(F.max("n_worth").alias("n_worth"))
        self.stats = self.keep(B.set_extremes(self.operators, self.summaries).join(worth, "cand_key", "left"), "set_stats")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return cut_lineage(df, name) if self.materialize else df

    @property
    def sets(self) -> DataFrame:
        """(cand_key, bucket, bits): never written, the OR of a few small rows."""
        n = int(self.products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return B.set_bitmaps(self.operators, self.summaries, n)

    @property
    def candidates(self) -> DataFrame:
        """One row per (cand_key, product), with the product features."""
        return B.set_rows(B.words(self.sets), self.slots)

    def _half(self, category: str, words: DataFrame) -> DataFrame:
        rows = B.set_rows(words, self.slots, self.slots.rows.where(F.col("category") == category))
        return with_stats(rows, self.set_rows, self.stats)

    @cached_property
    def g_components(self) -> DataFrame:
        return G.guaranteed_components(self._half("GUARANTEED", B.words(self.sets))).select(*G_COMPONENT_COLS)

    @cached_property
    def v_components(self) -> DataFrame:
        words = B.ranked_words(self.sets, self.counts, self.slots, self.edges)
        ranked = B.average_ranks(self._half("NON_GUARANTEED", words), self.slots, "worth_rank")
        v = V.variable_components(ranked, self.as_of, self.missing, self.set_rows)
        return v.select(*V_COMPONENT_COLS)

    def with_product_info(self, top: DataFrame, bound: int) -> DataFrame:
        """Attach the product texts to (at most ``bound``) top-n rows; the top rows are the broadcast side."""
        present = set(top.columns)
        attrs = self.products.select("product_id", *[c for c in PRODUCT_INFO if c not in present])
        # Top rows carry ~30 columns (scores, flags, ids): about 1 KB each.
        return attrs.join(bounded_broadcast(top, known_rows=bound, row_bytes=1024), "product_id")


class Scored:
    """Top-n per segment with reasons, over a :class:`Hub` (built here when not given).

    Each half is computed when first asked for and written once; a smaller top-n is the first
    rows of a larger one (``base``: same ranking and tie-break).
    """

    def __init__(self, profiles: DataFrame, catalog: dict[str, DataFrame] | None = None, as_of: str | None = None,
                 top_n: int = 3, missing: str = "zero", materialize: bool = True, hub: Hub | None = None,
                 base: "Scored | None" = None):
        if base is not None and top_n > base.top_n:
            raise ValueError("can only derive a smaller top-n")
        self.base = base
        self.hub = base.hub if base is not None else hub or Hub(profiles, catalog, as_of, missing, materialize)
        self.profiles = base.profiles if base is not None else profiles
        self.top_n = top_n
        self.segments = self.hub.segments
        self.set_rows = self.hub.set_rows

    @property
    def candidates(self) -> DataFrame:
        return self.hub.candidates

    @property
    def g_components(self) -> DataFrame:
        return self.hub.g_components

    @property
    def v_components(self) -> DataFrame:
        return self.hub.v_components

    @cached_property
    def g_top(self) -> DataFrame:
        if self.base is not None:
            return self.base.g_top.where(F.col("rank") <= self.top_n)
        top = G.guaranteed_topn(self.g_components, self.segments, self.top_n, self.set_rows)
        top = G.guaranteed_reasons(self.hub.with_product_info(top, 5 * self.top_n * self.set_rows))
        return self.hub.keep(top, f"g_top{self.top_n}")

    @cached_property
    def v_top(self) -> DataFrame:
        if self.base is not None:
            return self.base.v_top.where(F.col("rank") <= self.top_n)
        top = V.variable_topn(self.v_components, self.segments, self.top_n, self.set_rows)
        top = V.variable_reasons(self.hub.with_product_info(top, 20 * self.top_n * self.set_rows))
        return self.hub.keep(top, f"v_top{self.top_n}")

    @cached_property
    def g_items(self) -> DataFrame:
        """Per-segment item arrays (at most 5 rows per candidate set), broadcast to users by every portfolio."""
        if self.base is not None:
            return self.base.g_items.withColumn("g_items", F.slice("g_items", 1, self.top_n))
        items = _items(self.g_top, GUARANTEED_KEYS, "score", _G_SCORES).withColumnRenamed("items", "g_items")
        return self.hub.keep(items, f"g_items_top{self.top_n}")

    @cached_property
    def v_items(self) -> DataFrame:
        """Per-segment item arrays (at most 20 rows per candidate set), broadcast to users by every portfolio."""
        if self.base is not None:
            return self.base.v_items.withColumn("v_items", F.slice("v_items", 1, self.top_n))
        items = _items(self.v_top, SEGMENT_KEYS, "total_score", _V_SCORES).withColumnRenamed("items", "v_items")
        return self.hub.keep(items, f"v_items_top{self.top_n}")

    @cached_property
    def item_rows(self) -> tuple[int, int]:
        """Rows of the two item tables: counted from the written files, else their bounds."""
        if self.base is not None:
            return self.base.item_rows
        if not self.hub.materialize:
            return 5 * self.set_rows, 20 * self.set_rows
        return self.g_items.count(), self.v_items.count()


def _items(top: DataFrame, keys: list[str], score: str, scores: list[str]) -> DataFrame:
    item = F.struct(
        F.col("rank"),
        F.col("product_id"),
        F.col("product_name"),
        python_round1(F.col(score)).alias("score"),
        F.col(score).alias("raw_score"),
        F.col("reasons"),
        F.struct(*[F.col(c) for c in PRODUCT_INFO]).alias("product_info"),
        F.create_map(*[x for c in scores for x in (F.lit(c), F.col(c).cast("double"))]).alias("scores"),
    )
    by_rank = lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(item), by_rank).alias("items"))


def recommend(scored: Scored) -> DataFrame:
    """Per user: summary struct + ordered guaranteed / non_guaranteed item arrays."""
    # One row holds up to n items with reason texts and the product record: ~4 KB per item.
    item_bytes = 4096 * max(1, scored.top_n)
    g_rows, v_rows = scored.item_rows
    g_items = bounded_broadcast(scored.g_items, known_rows=g_rows, row_bytes=item_bytes)
    v_items = bounded_broadcast(scored.v_items, known_rows=v_rows, row_bytes=item_bytes)
    users = scored.profiles
    joined = users.join(g_items, GUARANTEED_KEYS, "left").join(v_items, SEGMENT_KEYS, "left")
    empty = F.array().cast(g_items.schema["g_items"].dataType)
    v_empty = F.array().cast(v_items.schema["v_items"].dataType)
    silver = V.silver_sentence(F.col("period"))
    non_g = F.transform(
        F.coalesce(F.col("v_items"), v_empty),
        lambda x: x.withField("reasons", F.when(F.col("is_silver"), F.concat(x["reasons"], F.array(silver)))
                              .otherwise(x["reasons"])),
    )
    summary = F.struct(
        F.col("risk_preference"),
        F.coalesce(F.col("investment_amount"), F.lit(0)).cast("long").alias("total_amt"),
        F.col("grnt_ratio"),
        (F.lit(1.0) - F.col("grnt_ratio")).alias("ungrnt_ratio"),
    )
    return joined.select(
        "user_id", "age", "period", "risk_preference", "is_silver", "manages_self", "cand_key",
        summary.alias("summary"),
        F.coalesce(F.col("g_items"), empty).alias("guaranteed"),
        non_g.alias("non_guaranteed"),
    )


def portfolio_flat(portfolio: DataFrame) -> DataFrame:
    """One row per (user, half, rank): the recommended items, flat."""
    def half(col, name):
        return portfolio.select("user_id", F.lit(name).alias("half"), F.explode(col).alias("it")).select(
            "user_id", "half", F.col("it.rank").cast("int").alias("rank"), F.col("it.product_id").alias("product_id"),
            F.col("it.product_name").alias("product_name"), F.col("it.score").alias("display_score"),
            F.round(F.col("it.raw_score"), 4).alias("score"),
            F.array_join(F.col("it.reasons"), " | ").alias("reasons"),
        )
    return half("guaranteed", "guaranteed").unionByName(half("non_guaranteed", "non_guaranteed"))


def latest_portfolio(history: DataFrame, key: str = "user_id", order: str = "turn") -> DataFrame:
    """The most recent portfolio per user from a history of (user, turn, portfolio columns).

    ``max_by`` keeps one value per group with partial aggregation, so a user with many
    turns never has their history gathered in one place.
    """
    cols = [c for c in history.columns if c not in (key, order)]
    latest = history.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_p"), F.max(order).alias(order))
    return latest.select(key, order, "_p.*")
