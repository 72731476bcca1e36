"""One row of facts per clean user, from one pass over the event log.

The log is aggregated per user before it meets the user table: map-side combine
reduces a user with a third of all events to one row per task, and raw events
are never shuffled. All yes/no facts travel as bits of a single integer, so the
shuffled row stays narrow however many flags there are.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.sources.userlog import UserLog, fold_parts

# Stage order and the events that mark them.
STAGES = (
    ("signup", "account_created"),
    ("first_session", "first_session"),
    ("feature", "feature_used"),
    ("trial", "trial_started"),
    ("purchase", "purchase_completed"),
)
CORE_ACTIVITY = ("session_start", "feature_used", "trial_started", "purchase_completed")
SESSION_EVENT = "session_start"
COLLABORATION = "collaboration_feature"
RETENTION_DAYS = (1, 7, 14, 30)
EARLY_DAY = 3

USER_COLUMNS = (
    "user_id", "app_id", "install_timestamp", "cohort_month", "country",
    "acquisition_channel", "ab_group",
)


def _marks(retention_days: tuple[int, ...], early_day: int) -> dict[str, Column]:
    """Condition of every yes/no fact. Day tests come first: they are cheap and
    spare most rows the text comparison."""
    name, day = F.col("event_name"), F.col("day_offset")
    collaborated = F.col("event_subtype") == COLLABORATION
    core = name.isin(*CORE_ACTIVITY)
    return {
        **{f"reached_{stage}": name == event for stage, event in STAGES},
        "has_core_activity": core,
        **{f"active_d{d}": (day == d) & core for d in retention_days},
        "used_collab": collaborated,
        "used_collab_early": (day <= early_day) & collaborated,
        "purchased_early": (day <= early_day) & (name == "purchase_completed"),
    }


def _bit_mask(marks: dict[str, Column]) -> Column:
    """One integer per event with a bit for every condition that holds."""
    bits = {mark: F.lit(1 << i) for i, mark in enumerate(marks)}
    # an event belongs to one stage at most, so these are tried until one matches
    stage_bit, others = F, []
    for mark, hit in marks.items():
        if mark.startswith("reached_"):
            stage_bit = stage_bit.when(hit, bits[mark])
        else:
            others.append(F.when(hit, bits[mark]).otherwise(F.lit(0)))
    if stage_bit is not F:
        others.append(stage_bit.otherwise(F.lit(0)))
    return reduce(add, others, F.lit(0))


def _chosen(flags: tuple[str, ...] | None, retention_days: tuple[int, ...], early_day: int) -> dict[str, Column]:
    marks = _marks(retention_days, early_day)
    return marks if flags is None else {f: marks[f] for f in flags}


def fact_columns(
    retention_days: tuple[int, ...] = RETENTION_DAYS, early_day: int = EARLY_DAY, flags: tuple[str, ...] | None = None
) -> list[Column]:
    """The aggregates of events that make facts."""
    name, day = F.col("event_name"), F.col("day_offset")
    session = name == SESSION_EVENT
    return [
        F.bit_or(_bit_mask(_chosen(flags, retention_days, early_day))).alias("marks"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(session).alias("session_count"),
        F.count_if((day <= early_day) & session).alias("early_sessions"),
        F.min(day).alias("first_event_day"),
        F.max(day).alias("last_event_day"),
        F.max("event_timestamp").alias("last_event_ts"),
        F.max(F.when(name == "purchase_completed", day)).alias("purchase_day"),
    ]


#: How two states of a user's facts become one.
MERGED_FACTS = {
    "marks": F.bit_or, "n_events": F.sum, "session_count": F.sum, "early_sessions": F.sum,
    "first_event_day": F.min, "last_event_day": F.max, "last_event_ts": F.max, "purchase_day": F.max,
}


def event_facts(
    events: DataFrame | UserLog,
    retention_days: tuple[int, ...] = RETENTION_DAYS,
    early_day: int = EARLY_DAY,
    flags: tuple[str, ...] | None = None,
) -> DataFrame:
    """(user_id, marks, counts and extremes) for every user id in the log.

    ``flags`` limits the yes/no facts to those a single mart needs, so that the
    scan reads no other columns; unused counts and extremes are pruned anyway.
    """
    columns = fact_columns(retention_days, early_day, flags)
    return fold_parts(events, lambda part: part.groupBy("user_id").agg(*columns))


def user_facts(
    clean_users: DataFrame,
    events: DataFrame | UserLog,
    retention_days: tuple[int, ...] = RETENTION_DAYS,
    early_day: int = EARLY_DAY,
    flags: tuple[str, ...] | None = None,
) -> DataFrame:
    """Facts of every clean user; users without events get zeros and NULL days.

    ``events`` may be the raw log: the join keeps clean users only.
    """
    return join_facts(clean_users, event_facts(events, retention_days, early_day, flags), retention_days, early_day, flags)


def join_facts(
    clean_users: DataFrame,
    per_user: DataFrame,
    retention_days: tuple[int, ...] = RETENTION_DAYS,
    early_day: int = EARLY_DAY,
    flags: tuple[str, ...] | None = None,
) -> DataFrame:
    """Facts of every clean user from the folded log."""
    joined = clean_users.select(*USER_COLUMNS).join(per_user, "user_id", "left")
    marks = F.coalesce(F.col("marks"), F.lit(0))
    flag_columns = [
        F.when(marks.bitwiseAND(F.lit(1 << i)) != 0, 1).otherwise(0).alias(mark)
        for i, mark in enumerate(_chosen(flags, retention_days, early_day))
    ]
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_events", "session_count", "early_sessions")]
    return joined.select(
        *USER_COLUMNS,
        *counts,
        "first_event_day",
        "last_event_day",
        (F.col("last_event_day") - F.col("first_event_day")).alias("lifetime_days"),
        "last_event_ts",
        F.coalesce(F.col("purchase_day"), F.lit(-1)).alias("purchase_day"),
        *flag_columns,
    )
