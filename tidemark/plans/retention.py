"""Cohort retention with maturity masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.dates import days_between, month_label
from tidemark.functions.numeric import round_to
from tidemark.plans.facts import RETENTION_DAYS

MASKED_DAYS = (14, 30)  # later days are hidden until the cohort is old enough


def cohort_retention(
    facts: DataFrame,
    days: tuple[int, ...] = RETENTION_DAYS,
    masked_days: tuple[int, ...] = MASKED_DAYS,
) -> DataFrame:
    """Per install month: share of active users seen exactly on day n.

    The cohort size counts users with at least one core activity, not installs.
    A masked day is NULL unless the log reaches that many days past the first of
    the month.
    """
    active = F.col("has_core_activity") == 1
    per_cohort = facts.groupBy("cohort_month").agg(
        F.sum("has_core_activity").alias("cohort_size"),
        *[
            round_to(F.lit(100.0) * F.avg(F.when(active, F.col(f"active_d{d}"))), 2).alias(f"d{d}")
            for d in days
        ],
        F.max(F.to_date("last_event_ts")).alias("last_seen"),
    )
    # one row per calendar month, so this window is tiny
    log_end = F.max("last_seen").over(Window.partitionBy())
    aged = per_cohort.withColumn("age", days_between(F.col("cohort_month"), log_end))

    def shown(d: int):
        value = F.col(f"d{d}")
        return F.when(F.col("age") >= d, value) if d in masked_days else value

    return (
        aged.filter(F.col("cohort_size") > 0)
        .select("cohort_month", "cohort_size", *[shown(d).alias(f"d{d}_retention_pct") for d in days])
        .orderBy("cohort_month")
    )


def retention_long(retention: DataFrame, days: tuple[int, ...] = RETENTION_DAYS) -> DataFrame:
    """(cohort, retention_day, retention_pct): the matrix in long form, masks kept as NULL."""
    cells = F.array(
        *[
            F.struct(F.lit(d).alias("retention_day"), F.col(f"d{d}_retention_pct").alias("retention_pct"))
            for d in days
        ]
    )
    return retention.select(month_label(F.col("cohort_month")).alias("cohort"), F.inline(cells))
