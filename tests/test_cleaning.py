from __future__ import annotations

import pytest

from tidemark.plans import cleaning


@pytest.fixture
def farm(make_users):
    """201 users on one device, 200 on another, and the tricky singles."""
    return make_users(
        *[{"user_id": i, "device_id": "farm"} for i in range(201)],
        *[{"user_id": 1000 + i, "device_id": "lab"} for i in range(200)],
        {"user_id": 2001, "device_id": None},
        {"user_id": 2002, "email": None},
        {"user_id": 2003, "email": "Talbot@x"},
        {"user_id": 2004, "email": "QA1@x"},
        {"user_id": 2005, "acquisition_channel": "internal_qa"},
        {"user_id": 2006, "acquisition_channel": "internal_qa", "email": None},
        {"user_id": 2007, "acquisition_channel": None, "email": "a-TEST@x"},
    )


def test_rules_and_thresholds(farm):
    flagged = {r.user_id for r in cleaning.flag_bots(farm).filter("is_suspected_bot").collect()}
    assert flagged == set(range(201)) | {2003, 2004, 2007}


def test_every_user_gets_exactly_one_flag(farm):
    result = cleaning.flag_bots(farm)
    assert result.count() == farm.count()
    assert result.select("user_id").distinct().count() == farm.count()
    assert result.columns == [*farm.columns, "is_suspected_bot"]


def test_threshold_is_a_parameter(farm):
    flagged = cleaning.flag_bots(farm, max_users_per_device=199).filter("is_suspected_bot")
    assert flagged.filter("device_id = 'lab'").count() == 200


def test_missing_devices_are_not_one_shared_device(make_users):
    users = make_users(*[{"user_id": i, "device_id": None} for i in range(250)])
    assert cleaning.flag_bots(users).filter("is_suspected_bot").count() == 0


def test_clean_events_drop_bots_and_unknown_users(make_users, make_events):
    users = make_users({"user_id": 1}, {"user_id": 2, "email": "bot@x"})
    events = make_events((1, "install", 0), (2, "install", 0), (99, "install", 0), (1, "session_start", 3))
    clean = cleaning.clean_users(cleaning.flag_bots(users))
    kept = cleaning.clean_events(events, clean)
    assert kept.columns == events.columns
    assert sorted((r.user_id, r.day_offset) for r in kept.collect()) == [(1, 0), (1, 3)]


def test_quality_counts(make_users):
    users = make_users(
        {"user_id": 1, "email": "bot@x", "is_bot_ground_truth": True},
        {"user_id": 2, "email": "abbot@x"},
        {"user_id": 3, "is_bot_ground_truth": True},
        {"user_id": 4, "is_bot_ground_truth": None},
    )
    row = cleaning.bot_filter_quality(cleaning.flag_bots(users)).first()
    assert tuple(row) == (1, 1, 1, 0.5, 0.5, 2, 2)


def test_quality_without_bots_is_zero_not_null(make_users):
    row = cleaning.bot_filter_quality(cleaning.flag_bots(make_users({"user_id": 1}))).first()
    assert tuple(row) == (0, 0, 0, 0.0, 0.0, 0, 0)


def test_device_reuse_counts_distinct_users(make_users, rows):
    users = make_users({"user_id": 1, "device_id": "a"}, {"user_id": 1, "device_id": "a"}, {"user_id": 2, "device_id": "a"}, {"user_id": 3, "device_id": None})
    assert rows(cleaning.device_reuse(users)) == [("a", 2), (None, 1)]
