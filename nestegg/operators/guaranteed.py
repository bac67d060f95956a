"""Principal-guaranteed product scoring.

The score depends on a user only through the risk class. Every candidate row is scored
for each class present among the users of its set (five at most), and the ranking
window keeps n rows a class in each map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nestegg import constants as K
from nestegg.functions.common import lookup
from nestegg.functions.scoring import guaranteed_fit, is_risky, is_safe, rate_weight
from nestegg.operators.candidates import near_top
from nestegg.session import bounded_broadcast


def guaranteed_features(products: DataFrame) -> DataFrame:
    """Product-level parts (E1): keyword flags on the name and the resulting kind."""
    return products.withColumns({
        "is_safe": is_safe(F.col("product_name")),
        "is_risky": is_risky(F.col("product_name")),
    }).withColumn("kind", F.when(F.col("is_risky"), "risky").when(F.col("is_safe"), "safe").otherwise("plain"))


def guaranteed_components(guaranteed: DataFrame) -> DataFrame:
    """Segment-free parts: keyword flags, kind and rate level (rate / max rate of the set * 100).

    ``guaranteed`` are guaranteed candidate rows carrying ``max_rate`` (see ``with_stats``)
    and either ``product_name`` or the flags of :func:`guaranteed_features`.
    A max rate of 0 gives NULL, never NaN.
    """
    df = guaranteed if "kind" in guaranteed.columns else guaranteed_features(guaranteed)
    return df.withColumn("rate_level", F.try_divide(F.col("interest_rate"), F.col("max_rate")) * F.lit(100.0))


def score_for_class(df: DataFrame, risk: str = "risk_preference") -> DataFrame:
    """product_score, rate_score and score of each row for the class in column ``risk``."""
    r = F.col(risk)
    return df.withColumns({
        "product_score": guaranteed_fit(F.col("is_risky"), F.col("is_safe"), r),
        "rate_score": F.col("rate_level") * rate_weight(r),
    }).withColumn(
        "score",
        F.lit(K.GUARANTEED_FIT_WEIGHT) * F.col("product_score").cast("double")
        + F.lit(K.GUARANTEED_RATE_WEIGHT) * F.col("rate_score"),
    )


def guaranteed_topn(components: DataFrame, segments: DataFrame, top_n: int = 3,
                    set_rows: int | None = None) -> DataFrame:
    """Top-n guaranteed products per (cand_key, risk_preference) present in ``segments``.

    Ties are broken by product_id; a NULL score sorts last.
    """
    classes = segments.select("cand_key", "risk_preference").distinct()
    bound = None if set_rows is None else 5 * set_rows  # five classes per set
    scored = score_for_class(components.join(bounded_broadcast(classes, known_rows=bound), "cand_key"))
    scored = near_top(scored, ["cand_key", "risk_preference"], "score", top_n, bound)
    w = Window.partitionBy("cand_key", "risk_preference").orderBy(F.col("score").desc_nulls_last(), "product_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def _fit_sentence(risky, safe, risk):
    on_risky = {K.STABLE: K.FIT_OFF, K.STABLE_SEEKING: K.FIT_PARTLY_OFF, K.NEUTRAL: K.FIT_PARTLY,
                K.ACTIVE: K.FIT_MOSTLY}
    on_safe = {K.STABLE: K.FIT_MATCH, K.STABLE_SEEKING: K.FIT_MOSTLY, K.NEUTRAL: K.FIT_PARTLY,
               K.ACTIVE: K.FIT_PARTLY_OFF}
    return (F.when(risky, lookup(on_risky, risk, K.FIT_MATCH))
            .when(safe, lookup(on_safe, risk, K.FIT_OFF)))


def guaranteed_reasons(scored: DataFrame, risk: str = "risk_preference") -> DataFrame:
    """Adds ``reasons`` (array<string>): fit sentence (if any) then the rate sentence."""
    r = F.col(risk)
    lvl = F.col("rate_level")
    rate_desc = F.when(lvl >= 80, K.RATE_HIGH).when(lvl >= 50, K.RATE_MID).otherwise(K.RATE_LOW)
    template = lookup(K.RATE_TEMPLATES, r, K.RATE_TEMPLATE_OTHER)
    rate_sentence = F.replace(template, F.lit("%s"), rate_desc)
    return scored.withColumn(
        "reasons", F.array_compact(F.array(_fit_sentence(F.col("is_risky"), F.col("is_safe"), r), rate_sentence)))
