"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def days_between(start: Column, end: Column) -> Column:
    """Whole calendar days from ``start`` to ``end``."""
    return F.datediff(F.to_date(end), F.to_date(start))


def week_start(moment: Column) -> Column:
    """Monday of the week, as a DATE."""
    return F.trunc(F.to_date(moment), "week")


def month_start(moment: Column) -> Column:
    return F.trunc(F.to_date(moment), "month")


def month_label(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")
