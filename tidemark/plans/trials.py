"""Daily activity after trial start and its steepest drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import pct, round_to
from tidemark.sources.userlog import UserLog, fold_parts

TRIAL_EVENT = "trial_started"
ACTIVE_EVENTS = ("session_start", "feature_used")
LAST_TRIAL_DAY = 30
BLOCK_DAYS = 64  # bits of a long


def _relative_mask(last_day: int) -> Column:
    """Bit d: some trial of the user had activity d days after its start.

    For each trial day the active bits are shifted so that the trial day is bit 0, taking in the first days of the next
    block, and all of these are combined: as many steps as trial days, and no list of days.
    """
    wanted = F.lit((1 << (last_day + 1)) - 1).cast("long")
    positions = F.sequence(F.lit(0), F.lit(BLOCK_DAYS - 1))

    def following(block: Column) -> Column:
        after = F.filter("blocks", lambda b: b["block"] == block["block"] + 1)
        return F.coalesce(F.get(F.transform(after, lambda b: b["active_bits"]), F.lit(0)), F.lit(0).cast("long"))

    def seen_from(block: Column, day: Column) -> Column:
        own = F.call_function("shiftrightunsigned", F.coalesce(block["active_bits"], F.lit(0).cast("long")), day)
        more = F.when(day > 0, F.call_function("shiftleft", following(block), F.lit(BLOCK_DAYS) - day)).otherwise(F.lit(0).cast("long"))
        return own.bitwiseOR(more).bitwiseAND(wanted)

    def of_block(mask: Column, block: Column) -> Column:
        starts = F.filter(positions, lambda i: F.getbit(F.coalesce(block["trial_bits"], F.lit(0).cast("long")), i) == 1)
        return F.aggregate(starts, mask, lambda m, day: m.bitwiseOR(seen_from(block, day)))

    return F.aggregate("blocks", F.lit(0).cast("long"), of_block)


def block_columns() -> list[Column]:
    """The aggregates of one user's events in one 64-day block: trials, and trial and active days as bits."""
    name, day_bit = F.col("event_name"), F.expr(f"shiftleft(1L, pmod(day_offset, {BLOCK_DAYS}))")
    return [
        F.count_if(name == TRIAL_EVENT).alias("n_trials"),
        F.bit_or(F.when(name == TRIAL_EVENT, day_bit)).alias("trial_bits"),
        F.bit_or(F.when(name.isin(*ACTIVE_EVENTS), day_bit)).alias("active_bits"),
    ]


def block_number() -> Column:
    return F.floor(F.col("day_offset") / BLOCK_DAYS).cast("int").alias("block")


def user_blocks(events: DataFrame | UserLog) -> DataFrame:
    """(user_id, n_trials, blocks) of every user with a trial or activity."""

    def fold(part: DataFrame) -> DataFrame:
        marked = part.filter(F.col("event_name").isin(TRIAL_EVENT, *ACTIVE_EVENTS))
        return (
            marked.groupBy("user_id", block_number())
            .agg(*block_columns())
            .groupBy("user_id")
            .agg(
                F.sum("n_trials").alias("n_trials"),
                F.collect_list(F.struct("block", "trial_bits", "active_bits")).alias("blocks"),
            )
        )

    return fold_parts(events, fold)


def trial_dropoff_curve(
    clean_users: DataFrame, events: DataFrame | UserLog, last_day: int = LAST_TRIAL_DAY
) -> DataFrame:
    """Share of trials with activity on each day since the trial start.

    The log is read once and folded to (user, 64-day block) with the active and
    the trial days as bit masks, so even a long and dense history shuffles a
    few rows per user and a user with a third of all events shuffles no more
    than that per task. Only clean users with a trial get further; a user has
    at most as many blocks as the log has 64-day periods.

    A repeated trial adds to the denominator and each of its days can be
    matched; a user counts once per relative day.
    """
    return curve_of_blocks(clean_users, user_blocks(events), last_day)


def curve_of_blocks(clean_users: DataFrame, folded: DataFrame, last_day: int = LAST_TRIAL_DAY) -> DataFrame:
    """The curve from the folded log."""
    if not 0 <= last_day < BLOCK_DAYS - 1:
        raise ValueError(f"the curve ends before day {BLOCK_DAYS - 1}")
    trial_users = (
        folded.filter(F.col("n_trials") > 0)
        .join(clean_users.select("user_id"), "user_id", "left_semi")
        .select("n_trials", _relative_mask(last_day).alias("seen"))
    )
    days = F.filter(F.sequence(F.lit(0), F.lit(last_day)), lambda d: F.getbit("seen", d) == 1)
    # day -1 carries the number of trials, so one aggregation yields both sides of the rate
    weighted = F.concat(
        F.array(F.struct(F.lit(-1).alias("day_offset"), F.col("n_trials").alias("weight"))),
        F.transform(days, lambda d: F.struct(d.alias("day_offset"), F.lit(1).cast("long").alias("weight"))),
    )
    per_day = trial_users.select(F.inline(weighted)).groupBy("day_offset").agg(F.sum("weight").alias("n"))
    # from here on there are at most last_day + 2 rows
    trials = F.max(F.when(F.col("day_offset") == -1, F.col("n"))).over(Window.partitionBy())
    daily = per_day.select("day_offset", pct(F.col("n"), trials).alias("pct_active")).filter("day_offset >= 0")
    previous = F.lag("pct_active").over(Window.orderBy("day_offset"))
    return daily.select(
        "day_offset",
        "pct_active",
        round_to(F.col("pct_active") - previous, 2).alias("day_over_day_change_pp"),
    ).orderBy("day_offset")


def dropoff_cliff(curve: DataFrame) -> DataFrame:
    """The day with the most negative change; the earliest one on a tie."""
    change = F.col("day_over_day_change_pp")
    return (
        curve.filter(change.isNotNull())
        .orderBy(change.asc(), F.col("day_offset").asc())
        .limit(1)
        .select(F.col("day_offset").alias("cliff_day"), change.alias("cliff_change_pp"), "pct_active")
    )


def curve_points(curve: DataFrame, day7_fallback: float | None = None) -> DataFrame:
    """One row: activity on day 0 and day 7, and the peak. A day absent from the curve is NULL, or the fallback given for day 7."""
    on = lambda d: F.max(F.when(F.col("day_offset") == d, F.col("pct_active")))
    return curve.agg(
        on(0).alias("day0_pct"),
        F.coalesce(on(7), F.lit(day7_fallback).cast("double")).alias("day7_pct"),
        F.max("pct_active").alias("peak_pct"),
    )
