from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from session import session  # noqa: E402

from tidemark.sources import schemas  # noqa: E402

SF_DIR = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
INSTALL = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    return session(cores=4)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def make_users(spark):
    """Users from partial dicts; unnamed columns get harmless values."""

    def build(*rows: dict):
        full = []
        for row in rows:
            uid = row["user_id"]
            base = {
                "app_id": 1,
                "install_timestamp": INSTALL,
                "cohort_month": dt.date(2024, 1, 1),
                "device_id": f"d{uid}",
                "country": "US",
                "acquisition_channel": "organic_search",
                "email": f"user{uid}@example.com",
                "ab_group": None,
                "is_bot_ground_truth": False,
            } | row
            full.append(tuple(base[name] for name in schemas.USERS.names))
        return spark.createDataFrame(full, schemas.USERS)

    return build


@pytest.fixture
def make_events(spark):
    """Events from (user_id, name, day[, subtype]) tuples."""

    def build(*rows: tuple):
        full = [
            (i, uid, 1, name, rest[0] if rest else None, INSTALL + dt.timedelta(days=day), day)
            for i, (uid, name, day, *rest) in enumerate(rows)
        ]
        return spark.createDataFrame(full, schemas.EVENTS)

    return build


@pytest.fixture
def rows():
    """Rows of a frame as plain tuples, sorted."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
