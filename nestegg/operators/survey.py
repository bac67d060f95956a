"""Survey answers and investor profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestegg import constants as K
from nestegg.functions.common import lookup, py_strip
from nestegg.functions.profile import (asset_allocation, candidate_key, is_silver, manage_style, manages_self,
                                       risk_class, risk_score)

RADIO_KEYS = [k for k, _, kind in K.SURVEY_STEPS if kind == "radio" and k != "direct_manage"]
NUMBER_KEYS = [k for k, _, kind in K.SURVEY_STEPS if kind == "number"]


def normalize_answers(raw: DataFrame) -> DataFrame:
    """Long raw widget answers ``(user_id, step_key, answer)`` -> one typed row per user.

    Radio answers keep their first character as the code, ``direct_manage`` is
    "starts with 1", the amount is entered in units of 10,000. The pivot is one
    shuffle on ``user_id`` with map-side partial aggregation; of several answers to a
    question the largest text counts.
    """
    wide = raw.groupBy("user_id").pivot("step_key", K.SURVEY_KEYS).agg(F.max("answer"))
    cols = [F.col("user_id")]
    for key in K.SURVEY_KEYS:
        a = F.col(f"`{key}`")
        if key == "investment_amount":
            v = F.try_multiply(py_strip(a).try_cast("long"), F.lit(K.AMOUNT_UNIT))
        elif key in NUMBER_KEYS:
            v = py_strip(a).try_cast("int")
        elif key == "direct_manage":
            v = F.when(a.isNotNull(), a.startswith("1"))
        elif key == "pension_operator":
            v = F.when(a.isNotNull(), F.split(a, ","))
        else:
            v = F.substring(a, 1, 1).try_cast("int")
        cols.append(v.alias(key))
    return wide.select(*cols)


def survey_next_step(answers: DataFrame) -> DataFrame:
    """First unanswered step per user, its display label, and the done / last-step flags."""
    nxt = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(k)) for k in K.SURVEY_KEYS])
    step_no = lookup({k: i + 1 for i, k in enumerate(K.SURVEY_KEYS)}, nxt)
    step_label = lookup({k: lbl for k, lbl, _ in K.SURVEY_STEPS if lbl}, nxt)
    question_label = lookup({k: q[0] for k, q in K.SURVEY_QUESTIONS.items()}, nxt)
    return answers.select(
        "user_id",
        nxt.alias("next_step"),
        step_no.cast("int").alias("step_no"),
        F.coalesce(step_label, question_label).alias("step_label"),
        nxt.isNull().alias("done"),
        F.coalesce(nxt == K.SURVEY_KEYS[-1], F.lit(False)).alias("is_last_step"),
    )


def survey_options(spark: SparkSession) -> DataFrame:
    """The questionnaire dimension: (step_key, label, option_code, option_text); 30 rows."""
    rows = [(key, label, int(opt[0]), opt)
            for key, (label, opts) in K.SURVEY_QUESTIONS.items() for opt in opts]
    return spark.createDataFrame(rows, "step_key string, label string, option_code int, option_text string")


def answer_texts(answers: DataFrame, options: DataFrame) -> DataFrame:
    """Radio answers as (user_id, step_key, option_code, option_text, label) rows.

    ``direct_manage`` is stored as a boolean: its option is 1 (true) or 2 (false).
    """
    keys = [k for k in [*RADIO_KEYS, "direct_manage"] if k in answers.columns]
    code = lambda k: F.when(F.col(k), 1).when(~F.col(k), 2) if k == "direct_manage" else F.col(k).cast("int")
    long = answers.select(
        "user_id",
        F.explode(F.array(*[F.struct(F.lit(k).alias("step_key"), code(k).alias("option_code"))
                            for k in keys])).alias("a"),
    ).select("user_id", "a.*")
    return long.join(F.broadcast(options), ["step_key", "option_code"], "left")


def build_profiles(answers: DataFrame) -> DataFrame:
    """Answers + risk_score, risk_preference, grnt_ratio and the segment inputs.

    Absent optional columns take the defaults (amount 0, direct_manage True,
    period 10); a stored NULL is kept as NULL.
    """
    cols = answers.columns
    df = answers
    if "investment_amount" not in cols:
        df = df.withColumn("investment_amount", F.lit(K.DEFAULT_AMOUNT).cast("long"))
    if "direct_manage" not in cols:
        df = df.withColumn("direct_manage", F.lit(K.DEFAULT_DIRECT_MANAGE))
    if "period" not in cols:
        df = df.withColumn("period", F.lit(K.DEFAULT_PERIOD))
    score = risk_score()
    return df.withColumns({
        "risk_score": score,
        "risk_preference": risk_class(score, F.col("loss_level")),
    }).withColumns({
        "grnt_ratio": asset_allocation(F.col("risk_preference")),
        "is_silver": is_silver(F.col("period")),
        "manages_self": manages_self(F.col("direct_manage")),
        "cand_key": candidate_key(F.col("pension_operator")),
    })


def with_profile_defaults(records: DataFrame) -> DataFrame:
    """Stored profile records in which fields may be missing, with the defaults of the recommendation step.

    A missing class is neutral, a missing amount 0, a missing period 10 (not silver), and a missing answer on
    direct management means self (unlike a survey answer, see ``profile.manages_self``). Absent columns are missing.
    """
    defaults = {"risk_preference": F.lit(K.DEFAULT_RISK), "investment_amount": F.lit(K.DEFAULT_AMOUNT).cast("long"),
                "period": F.lit(K.DEFAULT_PERIOD), "direct_manage": F.lit(K.DEFAULT_DIRECT_MANAGE)}
    filled = records.withColumns({c: F.coalesce(F.col(c), v) if c in records.columns else v for c, v in defaults.items()})
    return filled.withColumns({
        "grnt_ratio": asset_allocation(F.col("risk_preference")),
        "is_silver": is_silver(F.col("period")),
        "manages_self": manages_self(F.col("direct_manage")),
        "style": manage_style(F.col("direct_manage")),
    })
