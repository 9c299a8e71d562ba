"""Scalar expressions: exact integer division, score cleaning, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def idiv(a, b) -> Column:
    """SQL ``a div b``: exact integral division of two integers (NULL-safe)."""
    return F.call_function("div", _c(a), _c(b))


def clean_score(x) -> Column:
    """NaN and +-Infinity become NULL, so they can never win an ordering."""
    c = _c(x).cast("double")
    bad = F.isnan(c) | (c == F.lit(float("inf"))) | (c == F.lit(float("-inf")))
    return F.when(bad, F.lit(None).cast("double")).otherwise(c)


def safe_ratio(num, den) -> Column:
    """Double division that yields NULL instead of failing on a zero divisor."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
