"""Null-based numeric expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value), value)


def pct_change(now: Column, before: Column, zero_as: float | None = None) -> Column:
    """Percent change; a zero base gives null, or is replaced by ``zero_as``."""
    base = before if zero_as is None else F.when(before == 0, F.lit(float(zero_as))).otherwise(before)
    return F.try_divide(now - before, base) * 100


def null_safe_total(columns: list[str], digits: int = 2) -> Column:
    """Row-wise sum with nulls as zero. Noise of the sum is cut first, so ties round alike in any order of adding."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return F.round(F.round(total, digits + 6), digits)


def standardise(value: Column, mean: Column, std: Column) -> Column:
    """z-score; a zero (or undefined) deviation counts as 1 so constants become 0."""
    return (value - mean) / F.coalesce(F.nullif(std, F.lit(0.0)), F.lit(1.0))
