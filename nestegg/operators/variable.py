"""Market-linked (non-guaranteed) product scoring.

Per (cand_key, product) the components R (two variants: normal / silver), C, A,
S, the parsed risk level and the TDF flag are computed once. Rows are scored, narrow, for the
segments present among the users of their set (20 at most), and the ranking window keeps n
rows a segment in each map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestegg import constants as K
from nestegg.functions.scoring import (age_score, is_tdf, minmax_score, parse_risk_level, risk_level_score,
                                       tdf_fit, years_active)
from nestegg.operators.candidates import EPOCH, average_rank, near_top
from nestegg.session import bounded_broadcast


#: Levels of the risk matrix.
RISK_LEVELS = range(1, 1 + max(map(len, K.RISK_LEVEL_MATRIX.values())))


def score_return(df: DataFrame) -> DataFrame:
    """F1-F2: min-max normalised returns and R for both modes (``score_r``, ``score_r_silver``)."""
    df = df.withColumns({
        "norm_1y": minmax_score(F.col("return_1y"), F.col("min_1y"), F.col("max_1y")),
        "norm_3y": minmax_score(F.col("return_3y"), F.col("min_3y"), F.col("max_3y")),
        "norm_5y": minmax_score(F.col("return_5y"), F.col("min_5y"), F.col("max_5y")),
    })
    r1, r3, r5 = F.col("norm_1y"), F.col("norm_3y"), F.col("norm_5y")

    def combine(all3, no5):
        w1, w3, w5 = all3
        v1, v3 = no5
        return (F.when(r1.isNull(), F.lit(0.0))
                .when(r3.isNotNull() & r5.isNotNull(), F.lit(w1) * r1 + F.lit(w3) * r3 + F.lit(w5) * r5)
                .when(r3.isNotNull(), F.lit(v1) * r1 + F.lit(v3) * r3)
                .otherwise(F.lit(1.0) * r1))

    return df.withColumns({
        "score_r": combine(K.RETURN_WEIGHTS_NORMAL, K.RETURN_WEIGHTS_NORMAL_NO5),
        "score_r_silver": combine(K.RETURN_WEIGHTS_SILVER, K.RETURN_WEIGHTS_SILVER_NO5),
    })


def score_risk_level(df: DataFrame) -> DataFrame:
    """parsed risk level (the class-dependent F is applied per segment)."""
    return df.withColumn("parsed_risk", parse_risk_level(F.col("risk_level")))


def score_tdf_flag(df: DataFrame) -> DataFrame:
    """product TDF flag (0/1)."""
    return df.withColumn("product_tdf", is_tdf(F.col("eligible_tdf"), F.col("product_name")).cast("int"))


def score_fee(df: DataFrame) -> DataFrame:
    """cheaper fee scores higher; constant fee -> 50."""
    return df.withColumn("score_c", minmax_score(F.col("total_expense_ratio"), F.col("min_fee"), F.col("max_fee"),
                                                 invert=True))


def score_size(df: DataFrame, buckets: int = 128, set_rows: int | None = None) -> DataFrame:
    """F8: 100*(avg_rank-1)/(N-1) over non-null net worth; N <= 1 -> 50; NULL -> 0."""
    if "worth_rank" not in df.columns:
        df = average_rank(df, ["cand_key"], "total_net_worth", buckets=buckets, out="worth_rank", key_rows=set_rows)
    n = F.col("n_worth")
    a = F.when(n > 1, F.coalesce(F.lit(100.0) * (F.col("worth_rank") - 1) / (n - 1), F.lit(0.0))).otherwise(F.lit(50.0))
    return df.withColumn("score_a", a).drop("worth_rank")


def score_age(df: DataFrame, as_of: Column | str, missing: str = "zero") -> DataFrame:
    """Years since launch to ``as_of`` and its bucket score; NULL -> 0 (epoch under ``zero``)."""
    as_of_c = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    launch = F.col("launch_date").cast("date")
    if missing == "zero":
        launch = F.coalesce(launch, F.lit(EPOCH).cast("date"))
    years = years_active(launch, as_of_c)
    return df.withColumns({"years_active": years, "score_s": age_score(years)})


def variable_features(products: DataFrame, as_of: str, missing: str = "zero") -> DataFrame:
    """Product-level parts: parsed risk level (F3), TDF flag (F5), launch age and its score."""
    return score_age(score_tdf_flag(score_risk_level(products)), as_of, missing)


def variable_components(variable: DataFrame, as_of: str, missing: str = "zero",
                        set_rows: int | None = None) -> DataFrame:
    """All segment-free components for variable candidate rows carrying ``set_stats``.

    Product-level features are computed here unless already present (see
    :func:`variable_features`); the set-dependent ones (R, C, A) always are. ``worth_rank`` is taken
    from the rows when they carry it (``bitmaps.average_ranks``).
    """
    df = variable if "score_s" in variable.columns else variable_features(variable, as_of, missing)
    df = score_return(df)
    df = score_fee(df)
    return score_size(df, set_rows=set_rows)


def segment_terms(segments: DataFrame) -> DataFrame:
    """What a segment brings to the total: F by risk level, the fit of a TDF, and the weights of its mode.

    Worked out once a segment, so that a (segment, product) row only multiplies and adds.
    """
    weights = lambda w: F.struct(*[F.lit(float(w[c])).alias(c) for c in "RFCTAS"])
    return segments.withColumns({
        "_f": F.array(*[risk_level_score(F.col("risk_preference"), F.lit(level)) for level in RISK_LEVELS]),
        "_t": tdf_fit(F.col("manages_self")),
        "_w": F.when(F.col("is_silver"), weights(K.WEIGHTS_SILVER)).otherwise(weights(K.WEIGHTS_NORMAL)),
    })


def score_segments(rows: DataFrame) -> DataFrame:
    """per-segment F, T and total (weighted sum in the fixed term order) for component rows with a segment.

    Any NULL term makes the total NULL; a risk level outside the matrix has no F.
    """
    rows = rows if "_w" in rows.columns else segment_terms(rows)
    level, w = F.col("parsed_risk"), F.col("_w")
    rows = rows.withColumns({
        "score_r_mode": F.when(F.col("is_silver"), F.col("score_r_silver")).otherwise(F.col("score_r")),
        "score_f": F.when(level.between(RISK_LEVELS[0], RISK_LEVELS[-1]), F.get("_f", (level - RISK_LEVELS[0]).cast("int"))),
        "score_t": (F.col("product_tdf") * F.col("_t")).cast("double"),
    })
    total = (w["R"] * F.col("score_r_mode") + w["F"] * F.col("score_f") + w["C"] * F.col("score_c")
             + w["T"] * F.col("score_t") + w["A"] * F.col("score_a") + w["S"] * F.col("score_s"))
    return rows.withColumn("total_score", total).drop("_f", "_t", "_w")


#: What the totals need of a component row.
_SCORED = ["cand_key", "product_id", "score_r", "score_r_silver", "parsed_risk", "product_tdf", "score_c", "score_a", "score_s"]


def variable_topn(components: DataFrame, segments: DataFrame, top_n: int = 3,
                  set_rows: int | None = None) -> DataFrame:
    """Top-n variable products per segment (cand_key, risk_preference, is_silver, manages_self), by the exact total."""
    segs = segment_terms(segments.select("cand_key", "risk_preference", "is_silver", "manages_self").distinct())
    bound = None if set_rows is None else 20 * set_rows  # 5 classes x 2 x 2 per set
    more = [c for c in components.columns if c not in _SCORED]
    rows = components.select(*_SCORED, F.struct(*more).alias("more")) if more else components
    scored = score_segments(rows.join(bounded_broadcast(segs, known_rows=bound), "cand_key"))
    scored = near_top(scored, ["cand_key", "risk_preference", "is_silver", "manages_self"], "total_score", top_n, bound)
    w = Window.partitionBy("cand_key", "risk_preference", "is_silver", "manages_self") \
        .orderBy(F.col("total_score").desc_nulls_last(), "product_id")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return top.select(*[c for c in top.columns if c != "more"], *(["more.*"] if more else []))


def variable_reasons(scored: DataFrame) -> DataFrame:
    """F13 rules 1-5 per segment row (the silver sentence is per user, added later)."""
    risk = F.col("risk_preference")
    f, r, c = F.col("score_f"), F.col("score_r_mode"), F.col("score_c")
    f_sentence = (F.when(f == 100, F.format_string(K.VR_F_EXACT, risk, F.col("parsed_risk").cast("string")))
                  .when(f >= 60, F.format_string(K.VR_F_BROAD, risk))
                  .when(f > 0, F.lit(K.VR_F_SOME)))
    r_sentence = F.when(r >= 80, K.VR_R_TOP).when(r >= 50, K.VR_R_GOOD).otherwise(K.VR_R_OTHER)
    c_sentence = F.when(c >= 80, K.VR_C_LOW).when(c >= 50, K.VR_C_FAIR)
    t_sentence = F.when((F.col("score_t") > 0) & ~F.col("manages_self"), F.lit(K.VR_TDF))
    as_sentence = F.when((F.col("score_a") >= 70) & (F.col("score_s") >= 60), F.lit(K.VR_SIZE_AGE))
    return scored.withColumn(
        "reasons", F.array_compact(F.array(f_sentence, r_sentence, c_sentence, t_sentence, as_sentence)))


def silver_sentence(period: Column) -> Column:
    """The per-user silver-mode sentence (prints the user's own period)."""
    return F.format_string(K.VR_SILVER, period.cast("string"))
