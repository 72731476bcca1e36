"""A/B test and feature-adoption readouts as column expressions over grouped counts.

The statistics only need a handful of counts per arm, so the data is aggregated
once and everything after that is arithmetic on one row per experiment. Passing
``by`` gives one readout row per group (country, app, experiment id...).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.normal import chi2_upper_tail_1df, lower_tail, upper_tail, z_quantile
from tidemark.functions.numeric import ratio, round_to
from tidemark.functions.text import chi2_p_value_text, p_value_text

# Test design and labels of the readout.
ALPHA = 0.05
POWER = 0.8
N_TESTS = 2  # z-test and chi-square share the error budget
BONFERRONI_ALPHA = ALPHA / N_TESTS
SRM_ALPHA = 0.001
BASELINE_RATE = 0.12
TREATMENT_MULTIPLIER = 1.08
P_FLOOR = 1e-300
METRIC_LABEL = "A/B Test - Day 6 Trial Extension"
CHI2_LABEL = "Chi-Square: Collaboration Feature vs Conversion"
MONTHLY_TRIALS = 10_000
ARPU = 4.99


def arm_counts(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(ab_group, n_users, n_purchases). Purchases are per-user flags, so a second
    purchase does not add to either count."""
    return (
        facts.filter(F.col("ab_group").isNotNull())
        .groupBy(*by, "ab_group")
        .agg(F.count(F.lit(1)).alias("n_users"), F.sum("reached_purchase").alias("n_purchases"))
    )


def arms_side_by_side(arms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per experiment: n and conversions of control (c) and treatment (t)."""

    def of(group: str, count: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("ab_group") == group, F.col(count))), F.lit(0))

    return arms.groupBy(*by).agg(
        of("control", "n_users").alias("n_c"),
        of("control", "n_purchases").alias("x_c"),
        of("treatment", "n_users").alias("n_t"),
        of("treatment", "n_purchases").alias("x_t"),
    )


def srm_check(sides: DataFrame, srm_alpha: float = SRM_ALPHA) -> DataFrame:
    """Adds the sample-ratio chi-square against a 50/50 split."""
    expected = (F.col("n_c") + F.col("n_t")) / 2.0
    deviation = sum(ratio((F.col(n) - expected) * (F.col(n) - expected), expected) for n in ("n_c", "n_t"))
    return (
        sides.withColumn("srm_chi2", deviation)
        .withColumn("srm_p_value", chi2_upper_tail_1df("srm_chi2"))
        .withColumn("has_srm", F.col("srm_p_value") < srm_alpha)
    )


def required_n_per_arm(
    baseline: float = BASELINE_RATE, multiplier: float = TREATMENT_MULTIPLIER, alpha: float = ALPHA, power: float = POWER
) -> float:
    """Users per arm for a one-sided two-proportion test (a number of the design, not of the data)."""
    effect = 2 * (math.asin(math.sqrt(baseline * multiplier)) - math.asin(math.sqrt(baseline)))
    return 2 * ((z_quantile(1 - alpha) + z_quantile(power)) / effect) ** 2


def power_check(
    sides: DataFrame,
    baseline: float = BASELINE_RATE,
    multiplier: float = TREATMENT_MULTIPLIER,
    alpha: float = ALPHA,
    power: float = POWER,
) -> DataFrame:
    """Adds the required sample size and the power at the observed control rate.

    The effect assumed is the design multiplier, not the observed lift.
    """
    needed = required_n_per_arm(baseline, multiplier, alpha, power)
    rate = ratio(F.col("x_c"), F.col("n_c"))
    lifted = rate * multiplier
    effect = F.when(lifted <= 1.0, 2.0 * (F.asin(F.sqrt(lifted)) - F.asin(F.sqrt(rate))))
    return (
        sides.withColumn("required_n", F.lit(needed))
        .withColumn("is_adequately_powered", (F.col("n_c") >= needed) & (F.col("n_t") >= needed))
        .withColumn("effect_h", F.when(rate > 0, effect).when(rate == 0, F.lit(0.0)))
        .withColumn("power_z", F.col("effect_h") * F.sqrt(F.col("n_c") / 2.0) - z_quantile(1 - alpha))
        .withColumn("power", F.when(rate == 0, 0.0).otherwise(lower_tail("power_z")))
        .drop("power_z")
    )


def z_test(sides: DataFrame, alpha: float = ALPHA, significance: float = BONFERRONI_ALPHA) -> DataFrame:
    """Adds rates, lifts, the one-sided pooled z-test and normal intervals per arm."""
    z_ci = z_quantile(1 - alpha / 2)
    pooled = ratio(F.col("x_c") + F.col("x_t"), F.col("n_c") + F.col("n_t"))
    spread = F.sqrt(pooled * (1.0 - pooled) * (ratio(F.lit(1.0), F.col("n_c")) + ratio(F.lit(1.0), F.col("n_t"))))
    rates = sides.withColumn("rate_c", ratio(F.col("x_c"), F.col("n_c"))).withColumn(
        "rate_t", ratio(F.col("x_t"), F.col("n_t"))
    )
    lift = F.col("rate_t") - F.col("rate_c")
    tested = (
        rates.withColumn("absolute_lift", lift)
        .withColumn("relative_lift", F.when(F.col("rate_c") > 0, lift / F.col("rate_c")).when(F.col("rate_c") == 0, 0.0))
        .withColumn("z_stat", ratio(lift, spread))
        .withColumn("p_value", upper_tail("z_stat"))
        .withColumn("is_significant", F.col("p_value") < significance)
    )
    for arm in ("t", "c"):
        rate = F.col(f"rate_{arm}")
        margin = z_ci * F.sqrt(ratio(rate * (1.0 - rate), F.col(f"n_{arm}")))
        # least/greatest skip NULLs, so an empty arm needs the guard
        tested = tested.withColumn(
            f"ci_lower_{arm}", F.when(margin.isNotNull(), F.greatest(rate - margin, F.lit(0.0)))
        ).withColumn(f"ci_upper_{arm}", F.when(margin.isNotNull(), F.least(rate + margin, F.lit(1.0))))
    return tested


def ab_test_results(arms: DataFrame, by: tuple[str, ...] = (), label: str = METRIC_LABEL) -> DataFrame:
    """The full readout, one row per experiment."""
    return z_test(power_check(srm_check(arms_side_by_side(arms, by)))).select(
        *by,
        F.lit(label).alias("metric"),
        F.col("n_c").alias("control_n"),
        F.col("n_t").alias("treatment_n"),
        F.col("rate_c").alias("control_rate"),
        F.col("rate_t").alias("treatment_rate"),
        (F.col("relative_lift") * 100).alias("relative_lift_pct"),
        (F.col("absolute_lift") * 100).alias("absolute_lift_pp"),
        "z_stat",
        "p_value",
        "is_significant",
        "srm_p_value",
        "has_srm",
        round_to(F.col("required_n"), 0).alias("required_n_per_arm"),
        "is_adequately_powered",
        round_to(F.col("power"), 4).alias("observed_power"),
        "ci_lower_t",
        "ci_upper_t",
        "ci_lower_c",
        "ci_upper_c",
    )


def adoption_chi2(adoption: DataFrame, significance: float = BONFERRONI_ALPHA, label: str = CHI2_LABEL) -> DataFrame:
    """Chi-square of adoption vs conversion with Yates' correction; no row unless both groups exist."""

    def of(used: int, count: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("used_collab") == used, F.col(count))), F.lit(0)).cast("double")

    table = adoption.agg(
        F.countDistinct("used_collab").alias("groups"),
        of(1, "total_purchases").alias("a"),
        (of(1, "total_users") - of(1, "total_purchases")).alias("b"),
        of(0, "total_purchases").alias("c"),
        (of(0, "total_users") - of(0, "total_purchases")).alias("d"),
    ).filter(F.col("groups") == 2)
    a, b, c, d = (F.col(x) for x in "abcd")
    total = a + b + c + d
    chi2 = F.lit(0.0)
    for cell, row, column in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        expected = row * column / total
        gap = F.abs(cell - expected)
        corrected = gap - F.least(F.lit(0.5), gap)
        chi2 = chi2 + ratio(corrected * corrected, expected)
    tested = table.select(chi2.alias("chi2_stat")).withColumn("p", chi2_upper_tail_1df("chi2_stat"))
    return tested.select(
        F.lit(label).alias("test"),
        "chi2_stat",
        F.when(F.col("p").isNotNull(), F.greatest(F.col("p"), F.lit(P_FLOOR))).alias("p_value"),
        (F.col("p") < significance).alias("is_significant"),
        F.lit(significance).alias("bonferroni_alpha"),
    )


# Label texts of the report.
SRM_PASSED, SRM_FAILED = "SRM Passed", "SRM FAILED - Check Sample Ratio"


def ab_labels(results: DataFrame, chi2: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row of display strings for each readout; ``by`` names its group. The adoption test is one for all groups."""
    ab = results.select(
        *by,
        F.when(F.col("is_significant"), "Statistically Significant (α=0.025, Bonferroni)")
        .otherwise("Not Significant")
        .alias("significance_flag"),
        F.concat(F.lit("P-Value: "), F.format_string("%.4f", F.col("p_value"))).alias("p_value_display"),
        p_value_text(F.col("p_value")).alias("p_value_text"),
        F.when(F.col("p_value") < 0.01, "highly significant")
        .when(F.col("p_value") < 0.05, "significant")
        .otherwise("not significant")
        .alias("significance_text"),
        F.when(F.col("has_srm"), SRM_FAILED).when(~F.col("has_srm"), SRM_PASSED).alias("srm_check"),
    )
    behaviour = chi2.agg(F.max("p_value").alias("p"), F.bool_or("is_significant").alias("sig")).select(
        F.struct("p", "sig")
    )
    found = behaviour.scalar()
    return ab.select(
        "*",
        F.when(found["sig"], "Significant (α=0.025)").otherwise("Not Significant").alias("chi2_flag"),
        chi2_p_value_text(found["p"]).alias("chi2_p_value_text"),
    )


def revenue_impact(
    results: DataFrame, monthly_trials: int = MONTHLY_TRIALS, arpu: float = ARPU, by: tuple[str, ...] = ()
) -> DataFrame:
    """Extra subscribers and monthly revenue, rounded to whole subscribers and unrounded."""
    baseline = F.lit(float(monthly_trials)) * F.col("control_rate")
    extra = baseline * (F.col("relative_lift_pct") / 100)
    return results.select(
        *by,
        baseline.alias("baseline_conversions"),
        extra.alias("incremental_unrounded"),
        (extra * arpu).alias("mrr_unrounded"),
        F.rint(extra).cast("long").alias("incremental_subscribers"),
        (F.rint(extra) * arpu).alias("incremental_mrr"),
    )
