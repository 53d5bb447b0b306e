"""Decimal rounding that gives the same double on every engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_dp(x: Column | str, places: int) -> Column:
    """Round half up at ``places`` decimals in binary arithmetic, NULL stays NULL."""
    col = F.col(x) if isinstance(x, str) else x
    scale = F.lit(float(10**places))
    return F.floor(col * scale + F.lit(0.5)).cast("double") / scale


def clamp01(x: Column) -> Column:
    """Clamp to [0, 1]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
