"""Display strings for readouts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def contains_any(text: Column, *fragments: str) -> Column:
    """Case-insensitive "contains one of"; a NULL text counts as no match."""
    hit = F.lit(False)
    for fragment in fragments:
        hit = hit | F.contains(F.lower(text), F.lit(fragment.lower()))
    return F.coalesce(hit, F.lit(False))


def p_value_text(p: Column) -> Column:
    """Four decimals, or scientific notation below 1e-4."""
    return F.when(p >= 1e-4, F.format_string("%.4f", p)).when(
        p.isNotNull(), F.format_string("%.2e", p)
    )


def chi2_p_value_text(p: Column) -> Column:
    """Like :func:`p_value_text`, with a floor label for vanishing p-values."""
    return (
        F.when(p >= 1e-3, F.format_string("%.4f", p))
        .when(p > 1e-100, F.format_string("%.2e", p))
        .when(p.isNotNull(), F.lit("< 1e-100"))
    )


def thousands(value: Column, decimals: int = 0) -> Column:
    return F.format_number(value, decimals)


def clip(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)
