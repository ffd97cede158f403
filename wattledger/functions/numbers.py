"""Number semantics of the dashboard (IEEE doubles, half-up rounding, zero for missing)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves toward plus infinity (-2.5 becomes -2)."""
    return F.floor(x + F.lit(0.5))


def round_to_cents(x: Column) -> Column:
    """Two decimals by the same rule."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def or_zero(x: Column) -> Column:
    """Null and NaN count as zero."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def total_or_zero(x: Column) -> Column:
    """Sum that is zero, not null, for an empty group; works on decimals without losing cents."""
    return F.coalesce(F.sum(x).cast("double"), F.lit(0.0))


def truthy_or(x: Column, default: Column) -> Column:
    """``x`` unless it is null, NaN or zero, then ``default``."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (x != F.lit(0)), x).otherwise(default)


def leading_double(text: Column) -> Column:
    """Number at the start of a text ('12abc' gives 12.0); zero where there is none."""
    digits = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def leading_int(text: Column) -> Column:
    """Whole number at the start of a text; zero where there is none."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
