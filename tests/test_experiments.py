"""Published figures and edge cases of the readouts."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import normal, text
from tidemark.plans import experiments as ex, facts

ARMS = "ab_group string, n_users long, n_purchases long"


@pytest.fixture
def published(spark):
    return spark.createDataFrame([("control", 23795, 10767), ("treatment", 24000, 11348)], ARMS)


def test_erfc_against_the_math_library(spark):
    xs = [-6.0, -2.5, -0.4, 0.0, 1e-9, 0.3, 0.46875, 0.47, 1.0, 3.99, 4.0, 4.01, 9.0, 20.0, 26.0, 40.0]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    got = {r.x: r.y for r in df.select("x", normal.erfc("x").alias("y")).collect()}
    assert got[None] is None
    for x in xs:
        assert got[x] == pytest.approx(math.erfc(x), rel=1e-12, abs=1e-300)


def test_published_readout(published):
    row = ex.ab_test_results(published).first().asDict()
    assert list(row) == [
        "metric", "control_n", "treatment_n", "control_rate", "treatment_rate", "relative_lift_pct", "absolute_lift_pp",
        "z_stat", "p_value", "is_significant", "srm_p_value", "has_srm", "required_n_per_arm", "is_adequately_powered",
        "observed_power", "ci_lower_t", "ci_upper_t", "ci_lower_c", "ci_upper_c",
    ]
    assert row["z_stat"] == pytest.approx(4.45985, abs=1e-5)
    assert f"{row['p_value']:.2e}" == "4.10e-06"
    assert row["relative_lift_pct"] == pytest.approx(4.4959, abs=1e-4)
    assert row["absolute_lift_pp"] == pytest.approx(2.0343, abs=1e-4)
    assert row["srm_p_value"] == pytest.approx(0.34840, abs=1e-5) and row["has_srm"] is False
    assert row["required_n_per_arm"] == 14650.0 and row["is_adequately_powered"] is True
    assert row["observed_power"] > 0.9999 and row["is_significant"] is True
    margin = 1.959963984540054 * math.sqrt(row["control_rate"] * (1 - row["control_rate"]) / 23795)
    assert row["ci_lower_c"] == pytest.approx(row["control_rate"] - margin)
    assert row["ci_upper_c"] == pytest.approx(row["control_rate"] + margin)


def test_required_sample_size():
    assert ex.required_n_per_arm() == pytest.approx(14649.705, abs=1e-3)


def test_published_chi2(spark):
    adoption = spark.createDataFrame(
        [(1, 14612, 11281, 77.2), (0, 33183, 10834, 32.65)],
        "used_collab int, total_users long, total_purchases long, conversion_rate double",
    )
    row = ex.adoption_chi2(adoption).first()
    assert row.chi2_stat == pytest.approx(8098.625, abs=1e-3)
    assert row.p_value == 1e-300 and row.is_significant and row.bonferroni_alpha == 0.025


def test_chi2_needs_both_groups(spark):
    one = spark.createDataFrame([(0, 10, 5, 50.0)], "used_collab int, total_users long, total_purchases long, conversion_rate double")
    assert ex.adoption_chi2(one).count() == 0


def test_published_revenue(published):
    row = ex.revenue_impact(ex.ab_test_results(published)).first()
    assert row.incremental_subscribers == 203
    assert row.incremental_mrr == pytest.approx(1012.97)
    assert row.mrr_unrounded == pytest.approx(row.incremental_unrounded * 4.99)


def test_control_without_conversions(spark):
    row = ex.ab_test_results(spark.createDataFrame([("control", 50, 0), ("treatment", 50, 5)], ARMS)).first()
    assert row.control_rate == 0.0 and row.relative_lift_pct == 0.0 and row.observed_power == 0.0
    assert row.ci_lower_c == 0.0 and row.ci_lower_t == pytest.approx(0.1 - 1.959963984540054 * math.sqrt(0.09 / 50))


def test_nobody_converts(spark):
    row = ex.ab_test_results(spark.createDataFrame([("control", 50, 0), ("treatment", 50, 0)], ARMS)).first()
    assert row.z_stat is None and row.p_value is None and row.absolute_lift_pp == 0.0


@pytest.mark.parametrize("arms", [[("control", 50, 5)], [("treatment", 50, 5)], []])
def test_missing_arms_give_nulls(spark, arms):
    row = ex.ab_test_results(spark.createDataFrame(arms, ARMS)).first()
    assert row.p_value is None and row.absolute_lift_pp is None
    assert row.is_adequately_powered is False
    if not arms or arms[0][0] == "treatment":
        assert row.ci_lower_c is None and row.ci_upper_c is None


def test_second_purchase_does_not_inflate(make_users, make_events, rows):
    users = make_users({"user_id": 1, "ab_group": "control"}, {"user_id": 2, "ab_group": "treatment"}, {"user_id": 3})
    events = make_events((1, "purchase_completed", 1), (1, "purchase_completed", 2), (3, "purchase_completed", 2))
    assert rows(ex.arm_counts(facts.user_facts(users, events))) == [("control", 1, 1), ("treatment", 1, 0)]


def test_one_readout_per_group(make_users, make_events):
    users = make_users(
        *[{"user_id": i, "ab_group": "control" if i % 2 else "treatment", "country": "US" if i < 6 else "DE"} for i in range(10)]
    )
    arms = ex.arm_counts(facts.user_facts(users, make_events((1, "purchase_completed", 1))), ("country",))
    got = {r.country: (r.control_n, r.treatment_n, r.control_rate) for r in ex.ab_test_results(arms, ("country",)).collect()}
    assert got == {"US": (3, 3, pytest.approx(1 / 3)), "DE": (2, 2, 0.0)}


def test_labels(published, spark):
    chi2 = spark.createDataFrame([(1e-300, True)], "p_value double, is_significant boolean")
    row = ex.ab_labels(ex.ab_test_results(published), chi2).first()
    assert row.significance_flag == "Statistically Significant (α=0.025, Bonferroni)"
    assert row.p_value_display == "P-Value: 0.0000" and row.p_value_text == "4.10e-06"
    assert row.significance_text == "highly significant" and row.srm_check == "SRM Passed"
    assert row.chi2_flag == "Significant (α=0.025)" and row.chi2_p_value_text == "< 1e-100"


def test_p_value_texts(spark):
    df = spark.createDataFrame([(0.0001,), (0.00009,), (0.0005,), (1e-120,), (None,)], "p double")
    got = [tuple(r) for r in df.select(text.p_value_text(F.col("p")), text.chi2_p_value_text(F.col("p"))).collect()]
    assert got == [
        ("0.0001", "1.00e-04"), ("9.00e-05", "9.00e-05"), ("0.0005", "5.00e-04"), ("1.00e-120", "< 1e-100"), (None, None)
    ]
