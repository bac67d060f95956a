"""Product scoring expressions shared by the guaranteed and variable scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestegg import constants as K
from nestegg.functions.common import contains_any, lookup, py_strip


def is_safe(name: Column) -> Column:
    return contains_any(name, K.SAFE_KEYWORDS)


def is_risky(name: Column) -> Column:
    return contains_any(name, K.RISKY_KEYWORDS)


def guaranteed_fit(risky: Column, safe: Column, risk: Column) -> Column:
    """0; safe -> class table; risky -> class table (risky wins); unknown class -> 60."""
    return (F.when(risky, lookup(K.RISKY_FIT, risk, K.FIT_DEFAULT))
            .when(safe, lookup(K.SAFE_FIT, risk, K.FIT_DEFAULT))
            .otherwise(F.lit(0)))


def rate_weight(risk: Column) -> Column:
    return lookup(K.RATE_WEIGHT, risk, K.RATE_WEIGHT_DEFAULT).cast("double")


def minmax_score(x: Column, lo: Column, hi: Column, invert: bool = False) -> Column:
    """100*(x-lo)/(hi-lo) (or its complement); a constant column scores 50; NULL stays NULL."""
    # Same association as the formulas being matched: 100*(1-(x-lo)/(hi-lo)) and (100*(x-lo))/(hi-lo).
    if invert:
        scaled = F.lit(100.0) * (F.lit(1.0) - F.try_divide(x - lo, hi - lo))
    else:
        scaled = F.try_divide(F.lit(100.0) * (x - lo), hi - lo)
    return F.when(hi == lo, F.lit(50.0)).otherwise(scaled)


def parse_risk_level(text: Column) -> Column:
    """First run of digits as an int; no digits (or NULL, printed 'None') -> 6."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("None")), r"\d+", 0)
    # A digit run too long for a long is some level outside the matrix.
    return (F.when(digits == "", F.lit(K.RISK_LEVEL_NO_DIGITS).cast("long"))
            .otherwise(F.coalesce(digits.try_cast("long"), F.lit(-1).cast("long"))))


def risk_level_score(risk: Column, level: Column) -> Column:
    """Matrix lookup; an unknown class uses the neutral row; a level outside 1..6 is NULL."""
    known = F.lit(False)
    for name in K.RISK_LEVEL_MATRIX:
        known = known | F.coalesce(risk == name, F.lit(False))
    row_class = F.when(known, risk).otherwise(F.lit(K.RISK_LEVEL_DEFAULT_CLASS))
    out = None
    for name, row in K.RISK_LEVEL_MATRIX.items():
        for lvl, pts in enumerate(row, start=1):
            cond = (row_class == name) & (level == lvl)
            out = F.when(cond, pts) if out is None else out.when(cond, pts)
    return out.cast("double")


def is_tdf(eligible: Column, name: Column) -> Column:
    """Eligible flag 'O' (trimmed, any case) or 'TDF' in the upper-cased name."""
    flag = F.upper(py_strip(F.coalesce(eligible.cast("string"), F.lit("None")))) == "O"
    return flag | F.coalesce(F.upper(name).contains("TDF"), F.lit(False))


def tdf_fit(direct_manage_self: Column) -> Column:
    """Fit of a TDF to the management style: self 0, expert 100."""
    return F.when(direct_manage_self, F.lit(K.TDF_FIT[K.MANAGE_SELF])).otherwise(F.lit(K.TDF_FIT[K.MANAGE_EXPERT]))


def tdf_fit_of_style(style: Column) -> Column:
    """F6 for a management style as text: expert 100, advice 50, self 0, any other 50."""
    return lookup(K.TDF_FIT, style, K.TDF_FIT_DEFAULT)


def years_active(launch: Column, as_of: Column) -> Column:
    return F.datediff(as_of, launch).cast("double") / F.lit(K.DAYS_PER_YEAR)


def age_score(years: Column) -> Column:
    out = None
    for bound, pts in K.AGE_BUCKETS:
        out = F.when(years >= bound, pts) if out is None else out.when(years >= bound, pts)
    return F.when(years.isNull(), F.lit(0)).otherwise(out.otherwise(0)).cast("double")
