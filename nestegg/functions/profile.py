"""Risk profile expressions: points per answer, class, allocation, segment flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestegg import constants as K
from nestegg.functions.common import lookup


def _points(c: Column, table: dict, other: int) -> Column:
    out = None
    for code, pts in table.items():
        out = (F.when(c == code, pts) if out is None else out.when(c == code, pts))
    return out.otherwise(other)


def risk_score(age="age", period="period", experience="experience", psychology="psychology",
               loss_level="loss_level", finance_knowledge="finance_knowledge",
               investment_goal="investment_goal", pension_ratio="pension_ratio",
               expected_income="expected_income") -> Column:
    """Sum of the nine answer terms (0..100). A NULL answer falls to the term's ``else``."""
    a = F.col(age)
    age_pts = None
    for lo, hi, pts in K.AGE_POINTS:
        cond = (a >= lo) & (a <= hi)
        age_pts = F.when(cond, pts) if age_pts is None else age_pts.when(cond, pts)
    age_pts = age_pts.otherwise(K.AGE_POINTS_ELSE)

    p = F.col(period)
    period_pts = None
    for lo, pts in K.PERIOD_POINTS:
        period_pts = F.when(p >= lo, pts) if period_pts is None else period_pts.when(p >= lo, pts)
    period_pts = period_pts.otherwise(K.PERIOD_POINTS_ELSE)

    terms = [
        age_pts,
        period_pts,
        _points(F.col(experience), K.EXPERIENCE_POINTS, K.EXPERIENCE_POINTS_ELSE),
        _points(F.col(psychology), K.PSYCHOLOGY_POINTS, K.PSYCHOLOGY_POINTS_ELSE),
        _points(F.col(loss_level), K.LOSS_POINTS, K.LOSS_POINTS_ELSE),
        _points(F.col(finance_knowledge), K.KNOWLEDGE_POINTS, K.KNOWLEDGE_POINTS_ELSE),
        _points(F.col(investment_goal), K.GOAL_POINTS, K.GOAL_POINTS_ELSE),
        _points(F.col(pension_ratio), K.PENSION_RATIO_POINTS, K.PENSION_RATIO_POINTS_ELSE),
        _points(F.col(expected_income), K.INCOME_POINTS, K.INCOME_POINTS_ELSE),
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total.cast("int")


def risk_class(score: Column, loss_level: Column) -> Column:
    """Class by score; loss level 1 is stable outright, level 2 caps at neutral."""
    out = F.when(loss_level == K.LOSS_LEVEL_FORCE_STABLE, K.STABLE)
    for bound, name in K.CLASS_BOUNDS[:3]:
        out = out.when(score <= bound, name)
    out = out.when(loss_level == K.LOSS_LEVEL_CAP_NEUTRAL, K.NEUTRAL)
    bound, name = K.CLASS_BOUNDS[3]
    return out.when(score <= bound, name).otherwise(K.AGGRESSIVE)


def asset_allocation(risk: Column) -> Column:
    """Guaranteed share of the portfolio for a class (default 0.85)."""
    return lookup(K.GUARANTEED_SHARE, risk, K.GUARANTEED_SHARE_DEFAULT).cast("double")


def is_silver(period: Column) -> Column:
    """Retirement within the silver horizon; a NULL period is not silver."""
    return F.coalesce(period <= K.SILVER_MAX_PERIOD, F.lit(False))


def manages_self(direct_manage: Column) -> Column:
    """True only for an explicit True; False or NULL mean "leave it to an expert"."""
    return F.coalesce(direct_manage, F.lit(False))


def manage_style(direct_manage: Column) -> Column:
    return F.when(manages_self(direct_manage), K.MANAGE_SELF).otherwise(K.MANAGE_EXPERT)


def candidate_key(operators: Column) -> Column:
    """Order-free key of an operator list: sorted distinct names joined by '|' (escaped inside names, so keys never collide)."""
    escaped = F.transform(F.array_sort(F.array_distinct(operators)), lambda o: F.replace(F.replace(o, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")))
    return F.array_join(escaped, "|")
