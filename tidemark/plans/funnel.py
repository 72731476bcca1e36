"""Conversion funnel and feature adoption."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numeric import pct

# Report labels of the stages, in funnel order.
STAGE_COUNTS = (
    ("Install", "n_install"),
    ("Signup", "n_signup"),
    ("First Session", "n_first_session"),
    ("Feature Used", "n_feature"),
    ("Trial", "n_trial"),
    ("Purchase", "n_purchase"),
)
DROP_OFF = "Drop-Off"


def funnel_summary(facts: DataFrame) -> DataFrame:
    """One row: users per stage and step rates. Stages are flags, not a sequence:
    a user who bought without a trial counts as a purchaser."""
    counts = facts.agg(
        F.count(F.lit(1)).alias("n_install"),
        *[
            F.sum(f"reached_{stage}").alias(f"n_{stage}")
            for stage in ("signup", "first_session", "feature", "trial", "purchase")
        ],
    )
    steps = (
        ("pct_install_to_signup", "n_signup", "n_install"),
        ("pct_signup_to_session", "n_first_session", "n_signup"),
        ("pct_session_to_feature", "n_feature", "n_first_session"),
        ("pct_feature_to_trial", "n_trial", "n_feature"),
        ("pct_trial_to_purchase", "n_purchase", "n_trial"),
    )
    return counts.select("*", *[pct(F.col(part), F.col(whole)).alias(name) for name, part, whole in steps])


def funnel_transitions(funnel: DataFrame) -> DataFrame:
    """(source, target, value): users advancing to, or lost before, the next stage."""
    links = []
    for (source, before), (target, after) in zip(STAGE_COUNTS, STAGE_COUNTS[1:]):
        advanced, lost = F.col(after), F.col(before) - F.col(after)
        links.append(F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"), advanced.alias("value")))
        links.append(F.struct(F.lit(source).alias("source"), F.lit(DROP_OFF).alias("target"), lost.alias("value")))
    return funnel.select(F.inline(F.array(*links)))


def feature_adoption(facts: DataFrame) -> DataFrame:
    """Conversion of trial users with and without the collaboration feature, at any time."""
    return (
        facts.filter(F.col("reached_trial") == 1)
        .groupBy("used_collab")
        .agg(F.count(F.lit(1)).alias("total_users"), F.sum("reached_purchase").alias("total_purchases"))
        .select("*", pct(F.col("total_purchases"), F.col("total_users")).alias("conversion_rate"))
    )
