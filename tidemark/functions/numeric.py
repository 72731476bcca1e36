"""Ratios, percentages and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(value: Column, digits: int) -> Column:
    """Round half away from zero on the scaled double.

    ``F.round(x, 2)`` rounds the shortest decimal text of ``x`` (1.005 -> 1.01).
    SQL engines that scale the double first give 1.0, because 1.005 * 100 is
    100.49999999999999; the marts follow the latter.
    """
    scale = F.lit(float(10**digits))
    return F.round(value * scale) / scale


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, NULL when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole`` rounded, NULL when ``whole`` is zero."""
    return round_to(F.try_divide(F.lit(100.0) * part, whole.cast("double")), digits)


def to_number(text: Column, drop_chars: str = "") -> Column:
    """Numeric value of a text, NULL when it does not parse (or says NaN)."""
    stripped = F.translate(text, drop_chars, "") if drop_chars else text
    value = stripped.try_cast("double")
    return F.when(~F.isnan(value), value)
