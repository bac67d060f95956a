"""Generic Column helpers: literal lookups, Python-like strip, defaults."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every character for which str.isspace() holds;
# Java's (?U)\s is Unicode White_Space, plus the four separators Python adds.
_PY_SPACE = r"[\s\x1c-\x1f]"


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """``mapping.get(key, default)`` as a folded map literal."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    value = m[key]
    return value if default is None else F.coalesce(value, F.lit(default))


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: leading and trailing Unicode whitespace."""
    return F.regexp_replace(c, rf"(?U)^{_PY_SPACE}+|{_PY_SPACE}+$", "")


def contains_any(c: Column, words: list[str]) -> Column:
    """True when ``c`` contains any of ``words`` (NULL-safe: NULL text gives False)."""
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(c.contains(w), F.lit(False))
    return out


def col_or(df_columns: list[str], name: str, default) -> Column:
    """Optional input column: the column when present, else a literal default."""
    return F.col(name) if name in df_columns else F.lit(default)


def python_round1(x: Column) -> Column:
    """Python's ``round(x, 1)``: the binary value decides, exact half-way cases go to the even digit.

    10 x is p + e exactly: the product p as rounded, and its error e from the two halves of x
    (26 bits each, so ten times a half is exact). Half-way is decided by (p - floor(p) - 0.5) + e.
    """
    a = F.abs(x)
    p = a * 10.0
    big = a * 134217729.0  # 2^27 + 1
    high = big - (big - a)
    error = (high * 10.0 - p) + (a - high) * 10.0
    low = F.floor(p).cast("double")
    side = (p - low - 0.5) + error
    up = (side > 0) | ((side == 0) & (F.pmod(low, F.lit(2.0)) == 1))
    rounded = (low + F.when(up, 1.0).otherwise(0.0)) / 10.0
    return F.when(a < 1e15, F.when(x < 0, -rounded).otherwise(rounded)).otherwise(x)
