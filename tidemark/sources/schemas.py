"""Declared schemas. Timestamps are zone-free, as in the event log."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


APPS = _schema(
    app_id=T.IntegerType(),
    app_name=T.StringType(),
    category=T.StringType(),
    Rating=T.DoubleType(),
    Installs=T.LongType(),
    Price=T.DoubleType(),
)

USERS = _schema(
    user_id=T.LongType(),
    app_id=T.IntegerType(),
    install_timestamp=T.TimestampNTZType(),
    cohort_month=T.DateType(),
    device_id=T.StringType(),
    country=T.StringType(),
    acquisition_channel=T.StringType(),
    email=T.StringType(),
    ab_group=T.StringType(),
    is_bot_ground_truth=T.BooleanType(),
)

EVENTS = _schema(
    event_id=T.LongType(),
    user_id=T.LongType(),
    app_id=T.IntegerType(),
    event_name=T.StringType(),
    event_subtype=T.StringType(),
    event_timestamp=T.TimestampNTZType(),
    day_offset=T.IntegerType(),
)

RAW_CATALOG = _schema(
    App=T.StringType(),
    Category=T.StringType(),
    Rating=T.StringType(),
    Installs=T.StringType(),
    Price=T.StringType(),
)

TABLES = {"apps": APPS, "users": USERS, "events": EVENTS}
