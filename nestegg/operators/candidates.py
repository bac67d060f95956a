"""Eligible products per candidate set.

A candidate set is the sorted distinct operator list of a user (``cand_key``).
Products are expanded once per candidate set, never per user: the number of
rows is (candidate sets x eligible products), independent of the user count.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nestegg.session import BROADCAST_MAX_ROWS, bounded_broadcast

NUMERIC = ["interest_rate", "return_1y", "return_3y", "return_5y", "total_expense_ratio",
           "total_net_worth", "maturity"]

# Column -> value used under missing="zero" (the pandas fillna(0) of the reference).
ZERO_FILL = {
    "interest_rate": 0.0, "return_1y": 0.0, "return_3y": 0.0, "return_5y": 0.0,
    "total_expense_ratio": 0.0, "total_net_worth": 0.0, "maturity": 0.0,
    "risk_level": "0", "eligible_tdf": "0", "product_type": "0",
}
# launch_date stays NULL here: the filled value is the integer 0, which prints as "0" in a
# document but parses as the epoch when scored (see variable.score_age).
EPOCH = "1970-01-01"


def candidate_sets(profiles: DataFrame) -> DataFrame:
    """(cand_key, operator_name) for every distinct candidate set among users.

    Partial aggregation keeps each map task at one row per set before the shuffle.
    """
    sets = (profiles.where(F.col("cand_key").isNotNull() & (F.col("cand_key") != ""))
            .groupBy("cand_key").agg(F.first("pension_operator").alias("ops")))
    return (sets.select("cand_key", F.explode(F.array_distinct("ops")).alias("operator_name"))
            .where(F.col("operator_name").isNotNull()))


def products(catalog: dict[str, DataFrame]) -> DataFrame:
    """Product attributes: product_info LEFT fixed LEFT variable, the 14 selected columns.

    All three tables are keyed by id, so the two joins share one partitioning.
    """
    i = catalog["product_info"].select(F.col("id").alias("product_id"), "product_name", "product_type", "category")
    f = catalog["product_fixed"].select(F.col("id").alias("product_id"), "maturity", "interest_rate")
    v = catalog["product_variable"].select(
        F.col("id").alias("product_id"), "risk_level", "eligible_tdf", "launch_date", "total_net_worth",
        "total_expense_ratio",
        F.col("average_return_1y").alias("return_1y"),
        F.col("average_return_3y").alias("return_3y"),
        F.col("average_return_5y").alias("return_5y"),
    )
    return i.join(f, "product_id", "left").join(v, "product_id", "left")


def coerce(df: DataFrame, missing: str = "zero") -> DataFrame:
    """Numbers to double (bad values -> NULL, never an ANSI error); ``zero`` fills every NULL."""
    if missing not in ("zero", "null"):
        raise ValueError("missing must be 'zero' or 'null'")
    out = {c: F.col(c).try_cast("double") for c in NUMERIC}
    df = df.withColumns(out)
    if missing == "zero":
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in ZERO_FILL.items()})
    return df


def set_operators(profiles_or_sets: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    """(cand_key, operator_id) of every distinct candidate set."""
    sets = (profiles_or_sets if "operator_name" in profiles_or_sets.columns
            else candidate_sets(profiles_or_sets))
    ops = catalog["operator_info"].select(F.col("id").alias("operator_id"), "operator_name")
    return sets.join(ops, "operator_name").select("cand_key", "operator_id")


def candidate_pairs(profiles_or_sets: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    """Distinct (cand_key, product_id) a candidate set may buy.

    The mapping is joined to the small (set, operator) side without a shuffle of the
    mapping; duplicates (several operators or subscriber types per product) are
    removed on the two keys only, before any product attribute is attached.
    """
    # Small side: one row per (set, operator); size-checked before broadcasting.
    set_ops = set_operators(profiles_or_sets, catalog)
    return (catalog["product_mapping"].select("product_id", "operator_id")
            .join(bounded_broadcast(set_ops), "operator_id")
            .select("cand_key", "product_id")
            .distinct())


def product_table(catalog: dict[str, DataFrame], missing: str = "zero") -> DataFrame:
    """One coerced, filled row per product with the 14 selected columns."""
    return coerce(products(catalog), missing)


def candidates(profiles_or_sets: DataFrame, catalog: dict[str, DataFrame], missing: str = "zero") -> DataFrame:
    """One row per (cand_key, product) a candidate set may buy, coerced and filled.

    ``profiles_or_sets`` is either a profile table (with ``cand_key`` and
    ``pension_operator``) or the output of :func:`candidate_sets`.
    """
    return candidate_pairs(profiles_or_sets, catalog).join(product_table(catalog, missing), "product_id")


def split_category(cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(guaranteed, variable); a NULL category is in neither."""
    return (cands.where(F.col("category") == "GUARANTEED"),
            cands.where(F.col("category") == "NON_GUARANTEED"))


def set_stats(cands: DataFrame) -> DataFrame:
    """Per candidate set and category: the min/max/count statistics every score needs."""
    return cands.groupBy("cand_key", "category").agg(
        F.max("interest_rate").alias("max_rate"),
        F.min("return_1y").alias("min_1y"), F.max("return_1y").alias("max_1y"),
        F.min("return_3y").alias("min_3y"), F.max("return_3y").alias("max_3y"),
        F.min("return_5y").alias("min_5y"), F.max("return_5y").alias("max_5y"),
        F.min("total_expense_ratio").alias("min_fee"), F.max("total_expense_ratio").alias("max_fee"),
        F.count("total_net_worth").alias("n_worth"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def with_stats(cands: DataFrame, set_rows: int | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Attach :func:`set_stats` to every candidate row (broadcast when the stats are small).

    The stats have at most 3 rows (two categories and NULL) per candidate set; ``stats`` passes
    them when they are written already.
    """
    bound = None if set_rows is None else 3 * set_rows
    stats = set_stats(cands) if stats is None else stats
    stats = bounded_broadcast(stats.withColumnsRenamed({"cand_key": "_sk", "category": "_sc"}), known_rows=bound)
    # NULL-safe on category: a product without category stays a candidate (it is in neither half).
    cond = (F.col("cand_key") == F.col("_sk")) & F.col("category").eqNullSafe(F.col("_sc"))
    return cands.join(stats, cond).drop("_sk", "_sc")


def average_rank(df: DataFrame, keys: list[str], value: str, buckets: int = 128,
                 out: str = "avg_rank", key_rows: int | None = None) -> DataFrame:
    """pandas ``rank(method='average')`` of ``value`` within ``keys``; NULL stays NULL.

    A hot key (one candidate set may hold most rows) is never ranked in one task:
    values are counted per (keys, value), split into ``buckets`` value ranges by
    approximate quantiles, ranked inside each range, and offset by the exact
    prefix count of the earlier ranges. Every step is exact.
    """
    present = df.where(F.col(value).isNotNull())
    counts = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    probs = [i / buckets for i in range(1, buckets)]
    bounds = present.groupBy(*keys).agg(F.percentile_approx(value, probs, 1000).alias("_bounds"))
    counts = (counts.join(bounded_broadcast(bounds, known_rows=key_rows, row_bytes=64 + 8 * buckets), keys)
              .withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(value))))
              .drop("_bounds"))
    totals = counts.groupBy(*keys, "_bucket").agg(F.sum("_cnt").alias("_btot"))
    before_bucket = F.coalesce(F.sum("_btot").over(
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("_before_b", before_bucket).drop("_btot")
    inner = F.coalesce(F.sum("_cnt").over(
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = (counts.join(totals, [*keys, "_bucket"])
             .withColumn(out, (F.col("_before_b") + inner).cast("double") + (F.col("_cnt") + 1) / 2.0)
             .select(*keys, value, out))
    return df.join(ranks, [*keys, value], "left")


def near_top(scored: DataFrame, keys: list[str], score: str, top_n: int, key_rows: int | None = None, groups: int = 32,
             id_col: str = "product_id") -> DataFrame:
    """The rows of ``scored`` that can be among the ``top_n`` by ``score`` of their ``keys``, with all ties; exactly those are left out that cannot.

    The rows of a key fall into ``groups`` by their id; at least ``top_n`` rows reach the ``top_n``-th greatest of the
    groups' maxima, so a row below it is not among the first. Maxima are hash-aggregated, so that few rows come to
    the sort of a ranking. Keys without so many scores keep all rows, and so do more keys than can be broadcast.
    """
    groups = max(groups, 4 * top_n)
    if key_rows is None or key_rows > BROADCAST_MAX_ROWS:
        return scored
    best = scored.groupBy(*keys, F.pmod(F.xxhash64(id_col), F.lit(groups)).alias("_g")).agg(F.max(score).alias("_best"))
    least = best.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.get(F.sort_array(F.collect_list("_best"), asc=False), F.lit(top_n - 1)).alias("_least"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    near = scored.join(bounded_broadcast(least, known_rows=key_rows), same)
    return near.where(F.col("_least").isNull() | (F.col(score) >= F.col("_least"))).drop("_least", *[f"_{k}" for k in keys])
