from __future__ import annotations

import datetime as dt

import pytest

from tidemark.plans import engagement, facts, funnel, kpis, retention, segments, trials


def facts_of(users, events):
    return facts.user_facts(users, events)


# --- funnel and adoption -----------------------------------------------------


def test_funnel_flags_are_unordered_and_keep_silent_users(make_users, make_events):
    users = make_users(*[{"user_id": i} for i in (1, 2, 3)])
    events = make_events((1, "account_created", 0), (1, "purchase_completed", 2), (1, "purchase_completed", 3), (77, "trial_started", 1))
    row = funnel.funnel_summary(facts_of(users, events)).first().asDict()
    assert [row[c] for c in ("n_install", "n_signup", "n_first_session", "n_feature", "n_trial", "n_purchase")] == [3, 1, 0, 0, 0, 1]
    assert row["pct_install_to_signup"] == 33.33
    assert row["pct_signup_to_session"] == 0.0
    assert row["pct_session_to_feature"] is None and row["pct_trial_to_purchase"] is None


def test_transitions_split_every_stage(make_users, make_events):
    users = make_users(*[{"user_id": i} for i in (1, 2, 3)])
    events = make_events((1, "account_created", 0), (2, "account_created", 0), (1, "first_session", 0))
    links = {(r.source, r.target): r.value for r in funnel.funnel_transitions(funnel.funnel_summary(facts_of(users, events))).collect()}
    assert len(links) == 10
    assert links["Install", "Signup"] == 2 and links["Install", "Drop-Off"] == 1
    assert links["Signup", "First Session"] == 1 and links["Signup", "Drop-Off"] == 1
    assert links["Trial", "Purchase"] == 0


def test_adoption_counts_trial_users_only(make_users, make_events, rows):
    users = make_users(*[{"user_id": i} for i in (1, 2, 3, 4)])
    events = make_events(
        (1, "trial_started", 0), (1, "feature_used", 0, "collaboration_feature"), (1, "purchase_completed", 5),
        (2, "trial_started", 0), (2, "trial_started", 4), (2, "feature_used", 0, "standard_feature"),
        (3, "trial_started", 0),
        (4, "feature_used", 0, "collaboration_feature"), (4, "purchase_completed", 1),
    )
    assert rows(funnel.feature_adoption(facts_of(users, events))) == [(0, 2, 0, 0.0), (1, 1, 1, 100.0)]


def test_facts_with_chosen_flags_equal_full_facts(make_users, make_events, rows):
    users = make_users({"user_id": 1}, {"user_id": 2})
    events = make_events((1, "trial_started", 0), (2, "purchase_completed", 2), (2, "session_start", 7))
    flags = ("purchased_early", "reached_trial", "active_d7")
    some = facts.user_facts(users, events, flags=flags).select("user_id", *flags)
    assert rows(some) == rows(facts_of(users, events).select("user_id", *flags))


# --- retention ---------------------------------------------------------------


def retention_rows(users, events):
    return [tuple(r) for r in retention.cohort_retention(facts_of(users, events)).collect()]


@pytest.mark.parametrize("age, d14, d30", [(13, None, None), (14, 0.0, None), (29, 0.0, None), (30, 0.0, 0.0)])
def test_maturity_mask_opens_exactly_on_the_day(make_users, make_events, age, d14, d30):
    users = make_users({"user_id": 1}, {"user_id": 2})
    events = make_events((1, "session_start", 2), (2, "install", age))
    # user 2 has no core activity: it sets the end of the log but not the cohort size
    assert retention_rows(users, events) == [(dt.date(2024, 1, 1), 1, 0.0, 0.0, d14, d30)]


def test_retention_is_point_day(make_users, make_events):
    users = make_users({"user_id": 1}, {"user_id": 2}, {"user_id": 3})
    events = make_events(
        (1, "session_start", 1), (1, "session_start", 1), (2, "feature_used", 7), (3, "trial_started", 30), (3, "install", 1)
    )
    assert retention_rows(users, events) == [(dt.date(2024, 1, 1), 3, 33.33, 33.33, 0.0, 33.33)]


def test_retention_without_activity_is_empty(make_users, make_events):
    assert retention_rows(make_users({"user_id": 1}), make_events((1, "install", 0))) == []


def test_retention_long_keeps_masked_cells(make_users, make_events, rows):
    table = retention.cohort_retention(facts_of(make_users({"user_id": 1}), make_events((1, "session_start", 1))))
    assert rows(retention.retention_long(table)) == [
        ("2024-01", 1, 100.0), ("2024-01", 14, None), ("2024-01", 30, None), ("2024-01", 7, 0.0)
    ]


# --- trials ------------------------------------------------------------------


def curve_of(users, events):
    return trials.trial_dropoff_curve(users, events)


def test_curve_rebases_and_skips_absent_days(make_users, make_events):
    users = make_users(*[{"user_id": i} for i in (1, 2, 3)])
    events = make_events(
        (1, "trial_started", 5), (1, "session_start", 5), (1, "session_start", 5), (1, "feature_used", 8), (1, "session_start", 4),
        (1, "session_start", 36), (1, "session_start", 35),
        (2, "trial_started", 0), (2, "session_start", 0), (2, "purchase_completed", 1),
        (3, "session_start", 0),
    )
    assert [tuple(r) for r in curve_of(users, events).collect()] == [(0, 100.0, None), (3, 50.0, -50.0), (30, 50.0, 0.0)]


def test_repeated_trials_count_rows_below_and_users_above(make_users, make_events):
    users = make_users({"user_id": 1}, {"user_id": 2})
    events = make_events(
        (1, "trial_started", 0), (1, "trial_started", 0), (1, "trial_started", 3), (1, "session_start", 3), (1, "session_start", 6),
        (2, "trial_started", 1), (2, "session_start", 4),
    )
    # 4 trial rows; user 1 is active on relative days 0 (trial 3), 3 (both trials, once) and 6
    assert [tuple(r) for r in curve_of(users, events).collect()] == [(0, 25.0, None), (3, 50.0, 25.0), (6, 25.0, -25.0)]


def test_curve_across_blocks_of_days(make_users, make_events):
    users = make_users({"user_id": 1}, {"user_id": 2})
    events = make_events(
        *[(1, "trial_started", d) for d in (-1, 63)],
        *[(1, "session_start", d) for d in (-65, -2, -1, 0, 63, 64, 93, 94, 128)],
        (2, "trial_started", 127), (2, "feature_used", 127), (2, "session_start", 128), (2, "session_start", 157),
    )
    got = {r.day_offset: r.pct_active for r in curve_of(users, events).collect()}
    # user 1: trial -1 -> 0, 1; trial 63 -> 0, 1, 30; user 2: 0, 1, 30
    assert got == {0: 66.67, 1: 66.67, 30: 66.67}


def test_curve_ignores_filtered_users(make_users, make_events):
    events = make_events((1, "trial_started", 0), (1, "session_start", 0), (9, "trial_started", 0), (9, "session_start", 1))
    assert [tuple(r) for r in curve_of(make_users({"user_id": 1}), events).collect()] == [(0, 100.0, None)]


def test_cliff_prefers_the_earlier_day_on_a_tie(spark):
    curve = spark.createDataFrame(
        [(0, 90.0, None), (1, 60.0, -30.0), (2, 70.0, 10.0), (3, 40.0, -30.0)],
        "day_offset int, pct_active double, day_over_day_change_pp double",
    )
    assert tuple(trials.dropoff_cliff(curve).first()) == (1, -30.0, 60.0)
    assert tuple(trials.curve_points(curve).first()) == (90.0, None, 90.0)
    assert trials.curve_points(curve, 34.0).first().day7_pct == 34.0


# --- segments ----------------------------------------------------------------


def test_segment_rules_in_order(make_users, make_events):
    users = make_users(*[{"user_id": i} for i in range(1, 8)])
    events = make_events(
        (1, "purchase_completed", 0),
        (2, "session_start", 46), (2, "session_start", 46),
        (3, "session_start", 45),
        *[(4, "session_start", 60)] * 10,
        (5, "install", 60),
    )
    found = {r.user_id: r.user_segment for r in segments.assign_segments(facts_of(users, events)).collect()}
    assert found == {
        1: segments.CONVERTED,  # 60 days without a sign of life
        2: segments.AVERAGE,  # exactly 14 days ago
        3: segments.CHURNED,  # 15 days ago
        4: segments.POWER_USER,
        5: segments.AVERAGE,  # recent, never had a session
        6: segments.CHURNED,
        7: segments.CHURNED,
    }


def test_power_threshold_is_inclusive(make_users, make_events, rows):
    users = make_users({"user_id": 1}, {"user_id": 2})
    events = make_events((1, "session_start", 0), (2, "session_start", 0))
    assert rows(segments.user_segmentation(facts_of(users, events))) == [(segments.POWER_USER, 2, 100.0)]


def test_nobody_has_sessions(make_users, make_events, rows):
    assert rows(segments.user_segmentation(facts_of(make_users({"user_id": 1}), make_events((1, "install", 0))))) == [
        (segments.AVERAGE, 1, 100.0)
    ]


def test_churned_share_falls_back(spark):
    empty = spark.createDataFrame([("Converted", 1, 100.0)], "user_segment string, user_count long, pct_of_total double")
    assert segments.churned_pct(empty).first()[0] is None and segments.churned_pct(empty, 80.0).first()[0] == 80.0


# --- engagement --------------------------------------------------------------


def test_weekly_conversion_uses_monday_weeks(make_users, make_events):
    users = make_users(
        {"user_id": 1, "install_timestamp": dt.datetime(2024, 1, 7, 23)},
        {"user_id": 2, "install_timestamp": dt.datetime(2024, 1, 8)},
        {"user_id": 3, "install_timestamp": dt.datetime(2024, 1, 10)},
        {"user_id": 4, "install_timestamp": None},
    )
    table = engagement.weekly_conversion(facts_of(users, make_events((3, "purchase_completed", 1))))
    assert [tuple(r) for r in table.collect()] == [
        (dt.date(2024, 1, 1), 1, 0, 0.0), (dt.date(2024, 1, 8), 2, 1, 50.0)
    ]


def test_lifetimes_leave_silent_users_out(make_users, make_events):
    users = make_users(*[{"user_id": i} for i in (1, 2, 3)])
    events = make_events((1, "install", 0), (1, "session_start", 9), (2, "install", 4))
    assert tuple(engagement.lifetime_stats(facts_of(users, events)).first()) == (4.5, 9.0, 4.5)


def test_advanced_metrics_on_an_empty_log(make_users, make_events, spark):
    from tidemark.sources import schemas

    none = spark.createDataFrame([], schemas.EVENTS)
    table = engagement.advanced_analytics(facts_of(make_users({"user_id": 1}), none))
    assert {r.metric: r.value for r in table.collect()} == {
        "top_10_pct_avg_sessions": 0.0, "median_user_sessions": 0.0, "bottom_10_pct_avg_sessions": 0.0,
        "q1_avg_sessions": 0.0, "q2_avg_sessions": 0.0, "q3_avg_sessions": 0.0, "q4_avg_sessions": 0.0,
        "avg_lifetime_days": 0.0, "max_lifetime_days": 0.0, "median_lifetime_days": 0.0,
        "weekly_conv_rate_min": 0.0, "weekly_conv_rate_max": 0.0,
    }


def test_kpis_survive_missing_inputs(make_users, make_events):
    users, events = make_users({"user_id": 1}), make_events((1, "account_created", 0))
    f = facts_of(users, events)
    row = kpis.kpi_summary(
        funnel.funnel_summary(f), curve_of(users, events), segments.user_segmentation(f),
        funnel.feature_adoption(f), engagement.advanced_analytics(f),
    ).first().asDict()
    assert row["total_installs"] == 1.0 and row["signup_rate"] == 1.0
    assert row["trial_to_paid_rate"] == 0.0  # no trials: zero, not NULL
    assert row["cliff_day"] is None and row["adoption_ratio"] is None
    assert row["day7_pct"] is None and row["churned_pct"] is None  # nothing invented


def test_dropoff_curve_of_a_user_with_thousands_of_days(spark, make_users):
    """Every day a trial start and an active day: no list of day pairs is ever built."""
    days = spark.range(2000).selectExpr("id", "CAST(id AS INT) AS day_offset")
    events = days.selectExpr("1L AS user_id", "'trial_started' AS event_name", "day_offset").unionAll(
        days.selectExpr("1L AS user_id", "'session_start' AS event_name", "day_offset")
    )
    curve = trials.trial_dropoff_curve(make_users({"user_id": 1}), events)
    assert {r.day_offset for r in curve.collect()} == set(range(31))
    assert {r.pct_active for r in curve.collect()} == {0.05}
