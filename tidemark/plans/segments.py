"""Rule-based user segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.dates import days_between
from tidemark.functions.numeric import pct

INACTIVE_DAYS = 14
POWER_PERCENTILE = 0.9

# Segment labels of the report.
CONVERTED = "Converted"
CHURNED = "Churned (>14d inactive)"
POWER_USER = "Power User"
AVERAGE = "At-Risk / Average"


def assign_segments(
    facts: DataFrame, inactive_days: int = INACTIVE_DAYS, power_percentile: float = POWER_PERCENTILE
) -> DataFrame:
    """(user_id, user_segment); the first matching rule wins.

    The power threshold is a percentile over users with at least one session.
    Session counts take few distinct values, and Spark's exact percentile keeps
    one counter per distinct value, combined map-side.
    """
    sessions = F.col("session_count")
    thresholds = facts.agg(
        F.max("last_event_ts").alias("log_end"),
        F.percentile(F.when(sessions > 0, sessions), power_percentile).alias("power_sessions"),
        # same columns as the other use of the facts, so their shuffle is reused
        F.max("reached_purchase").alias("any_purchase"),
    )
    threshold = thresholds.select(F.struct("log_end", "power_sessions", "any_purchase")).scalar()
    segment = (
        F.when(F.col("reached_purchase") == 1, CONVERTED)
        .when(F.col("last_event_ts").isNull(), CHURNED)
        .when(days_between(F.col("last_event_ts"), threshold["log_end"]) > inactive_days, CHURNED)
        .when(sessions >= threshold["power_sessions"], POWER_USER)
        .otherwise(AVERAGE)
    )
    return facts.select("user_id", segment.alias("user_segment"))


def user_segmentation(facts: DataFrame, **rules) -> DataFrame:
    """(user_segment, user_count, pct_of_total)."""
    sizes = assign_segments(facts, **rules).groupBy("user_segment").agg(F.count(F.lit(1)).alias("user_count"))
    # four rows at most
    total = F.sum("user_count").over(Window.partitionBy())
    return sizes.select("*", pct(F.col("user_count"), total).alias("pct_of_total"))


def churned_pct(segmentation: DataFrame, fallback: float | None = None) -> DataFrame:
    """One row: the share of the segment whose name mentions churn; NULL, or the fallback given, if there is none."""
    hit = F.coalesce(F.col("user_segment").ilike("%churned%"), F.lit(False))
    return segmentation.agg(F.coalesce(F.max(F.when(hit, F.col("pct_of_total"))), F.lit(fallback).cast("double")).alias("churned_pct"))
