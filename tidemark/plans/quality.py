"""Data-quality expectations: every check yields (check, n_bad, passed).

Checks report, they do not raise; a caller decides what a failure means.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _row(name: str, bad: DataFrame) -> DataFrame:
    """``bad`` is a one-row frame with a column n_bad; without a figure the check fails."""
    n_bad = F.coalesce(F.col("n_bad").cast("long"), F.lit(1))
    return bad.select(F.lit(name).alias("check"), n_bad.alias("n_bad"), (n_bad == 0).alias("passed"))


def _nothing_there() -> Column:
    """1 if the aggregated input is empty: nothing was checked, so the check fails."""
    return (F.count(F.lit(1)) == 0).cast("int")


def _broken(condition: Column) -> Column:
    """Rows where a condition holds or can't be told."""
    return F.count_if(F.coalesce(condition, F.lit(True)))


def _violations(name: str, df: DataFrame, *bad: Column) -> DataFrame:
    """Counts (row, condition) pairs that hold or can't be told; an empty input counts as one."""
    return _row(name, df.agg(reduce(lambda a, b: a + b, [_broken(c) for c in bad], _nothing_there()).alias("n_bad")))


def _flag(name: str, one_row: DataFrame, bad: Column) -> DataFrame:
    return _violations(name, one_row, bad)


def unique_key(name: str, df: DataFrame, key: str) -> DataFrame:
    """Keys that are NULL or occur more than once."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _violations(name, groups, F.col(key).isNull() | (F.col("n") > 1))


def required_values(name: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a NULL in any of the columns."""
    return _violations(name, df, reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def none_quarantined(name: str, quarantined: DataFrame) -> DataFrame:
    """Lines of an input that didn't fit its schema."""
    return _row(name, quarantined.agg(F.count(F.lit(1)).alias("n_bad")))


def bots_removed(flagged: DataFrame) -> DataFrame:
    """Fails unless the filter removed at least one user."""
    return _row("clean_users_fewer_than_raw", flagged.agg((F.count_if("is_suspected_bot") == 0).cast("int").alias("n_bad")))


def funnel_monotone(funnel: DataFrame) -> DataFrame:
    stages = ["n_install", "n_signup", "n_first_session", "n_feature", "n_trial", "n_purchase"]
    return _violations("funnel_monotone", funnel, *[F.col(b) > F.col(a) for a, b in zip(stages, stages[1:])])


def step_rates_consistent(funnel: DataFrame, tolerance: float = 0.01) -> DataFrame:
    steps = (
        ("pct_install_to_signup", "n_signup", "n_install"),
        ("pct_signup_to_session", "n_first_session", "n_signup"),
        ("pct_session_to_feature", "n_feature", "n_first_session"),
        ("pct_feature_to_trial", "n_trial", "n_feature"),
        ("pct_trial_to_purchase", "n_purchase", "n_trial"),
    )
    gaps = [
        F.abs(F.try_divide(F.lit(100.0) * F.col(part), F.col(whole).cast("double")) - F.col(pct)) >= tolerance
        for pct, part, whole in steps
    ]
    return _violations("step_rates_consistent", funnel, *gaps)


def rate_near(name: str, one_row: DataFrame, rate: Column, expected: float, margin: float) -> DataFrame:
    return _flag(name, one_row, ~rate.between(expected - margin, expected + margin))


def no_srm(results: DataFrame) -> DataFrame:
    return _flag("no_sample_ratio_mismatch", results, F.col("has_srm"))


def plausible_rates(results: DataFrame, low: float = 0.25, high_control: float = 0.60, high_treatment: float = 0.65) -> DataFrame:
    return _violations(
        "ab_rates_plausible",
        results,
        ~F.col("control_rate").between(low, high_control),
        ~F.col("treatment_rate").between(low, high_treatment),
    )


def no_leakage(features: DataFrame, events: DataFrame, early_day: int = 3) -> DataFrame:
    """Training rows of users with an early purchase in the log."""
    early = (
        events.filter((F.col("event_name") == "purchase_completed") & (F.col("day_offset") <= early_day))
        .groupBy("user_id")
        .agg(F.lit(True).alias("early"))
    )
    joined = features.select("user_id").join(early, "user_id", "left")
    return _violations("no_label_leakage", joined, F.col("early").isNotNull())


def retention_in_range(retention: DataFrame) -> DataFrame:
    """Shares outside 0 to 100; those of cohorts that aren't old enough yet are NULL by rule."""
    masked = ("d14_retention_pct", "d30_retention_pct")
    shares = [c for c in retention.columns if c.endswith("_retention_pct")]
    outside = [~F.col(c).between(0, 100) for c in shares]
    return _violations(
        "retention_pct_in_range", retention, *[F.coalesce(o, F.lit(False)) if c in masked else o for c, o in zip(shares, outside)]
    )


def d1_at_least_d7(retention: DataFrame) -> DataFrame:
    return _violations("d1_retention_at_least_d7", retention, F.col("d1_retention_pct") < F.col("d7_retention_pct"))


def segments_sum_to_100(segmentation: DataFrame, tolerance: float = 0.1) -> DataFrame:
    total = segmentation.agg(F.sum("pct_of_total").alias("total"))
    return _flag("segment_pct_sums_to_100", total, F.abs(F.col("total") - 100) >= tolerance)


def importances_sum_to_one(importances: DataFrame, tolerance: float = 0.01) -> DataFrame:
    total = importances.agg(F.sum("Importance").alias("total"))
    return _flag("importances_sum_to_1", total, F.abs(F.col("total") - 1) >= tolerance)


def curve_non_increasing(curve: DataFrame, from_day: int = 8) -> DataFrame:
    """Days from ``from_day`` on that are above the one before them there; the first has none before it."""
    # the curve has one row per trial day
    previous = F.lag("pct_active").over(Window.orderBy("day_offset"))
    later = curve.filter(F.col("day_offset") >= from_day).select("pct_active", previous.alias("previous"))
    rises = F.when(F.col("previous").isNotNull(), F.col("pct_active") > F.col("previous")).otherwise(F.col("pct_active").isNull())
    return _violations("curve_non_increasing_after_peak", later, rises)


def cliff_on_day(cliff: DataFrame, expected_day: int) -> DataFrame:
    return _flag("cliff_on_expected_day", cliff, F.col("cliff_day") != expected_day)


def present(name: str, df: DataFrame, expected: list[str]) -> DataFrame:
    """Expected columns that are absent, and one more if the table has no row."""
    missing = len(set(expected) - set(df.columns))
    return _row(name, df.limit(1).agg((F.lit(missing) + _nothing_there()).alias("n_bad")))


def quality_report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def failed(report: DataFrame) -> list[tuple[str, int]]:
    """(check, n_bad) of the checks that didn't pass; a report has a row a check."""
    return [(row["check"], row["n_bad"]) for row in report.filter(~F.col("passed")).orderBy("check").collect()]
