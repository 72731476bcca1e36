"""Headline figures drawn from the marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numeric import ratio, ratio_or_zero
from tidemark.plans.segments import churned_pct
from tidemark.plans.trials import curve_points, dropoff_cliff

KPIS = (
    "total_installs", "trial_starters", "trial_start_rate", "trial_to_paid_rate", "signup_rate",
    "churned_pct", "cliff_day", "cliff_change_pp", "day0_pct", "day7_pct", "peak_pct",
    "adoption_ratio", "weekly_conversion_range",
)


def _long(one_row: DataFrame) -> DataFrame:
    columns = [F.col(c).cast("double").alias(c) for c in one_row.columns]
    return one_row.select(*columns).unpivot([], one_row.columns, "metric", "value")


def with_top_feature(kpis: DataFrame, importances: DataFrame) -> DataFrame:
    """The KPIs with the model's most important feature and its importance."""
    top = importances.orderBy(F.desc("Importance"), "Feature").limit(1).select(F.struct("Feature", "Importance")).scalar()
    return kpis.select("*", top["Feature"].alias("top_feature"), top["Importance"].alias("top_feature_importance"))


def kpi_summary(
    funnel: DataFrame, curve: DataFrame, segmentation: DataFrame, adoption: DataFrame, advanced: DataFrame
) -> DataFrame:
    """One row of KPIs. The inputs are finished marts of a few rows each."""
    rates = funnel.select(
        F.col("n_install").alias("total_installs"),
        F.col("n_trial").alias("trial_starters"),
        ratio_or_zero(F.col("n_trial"), F.col("n_install")).alias("trial_start_rate"),
        ratio_or_zero(F.col("n_purchase"), F.col("n_trial")).alias("trial_to_paid_rate"),
        ratio_or_zero(F.col("n_signup"), F.col("n_install")).alias("signup_rate"),
    )

    def rate_of(used: int):
        return F.max(F.when(F.col("used_collab") == used, F.col("conversion_rate")))

    def metric(name: str):
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    parts = [
        rates,
        churned_pct(segmentation),
        dropoff_cliff(curve).select("cliff_day", "cliff_change_pp"),
        curve_points(curve),
        adoption.agg(ratio(rate_of(1), rate_of(0)).alias("adoption_ratio")),
        advanced.agg(
            (metric("weekly_conv_rate_max") - metric("weekly_conv_rate_min")).alias("weekly_conversion_range")
        ),
    ]
    found = reduce(DataFrame.unionByName, [_long(p) for p in parts])
    return found.agg(*[metric(k).alias(k) for k in KPIS])
