"""Session bands, lifetimes and weekly conversion.

All of it follows from three histograms of the user facts: users per session
count, per lifetime and per install week. They are built in one aggregation and
are small (see operators.ordering), whatever the number of users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.dates import week_start
from tidemark.functions.numeric import ratio, round_to
from tidemark.operators.ordering import SMALL, histogram, ntile_share, percent_rank, running_total

SESSIONS, LIFETIME, WEEK = "sessions", "lifetime", "week"
BAND = 0.1
QUARTILES = 4


def distributions(facts: DataFrame, kinds: tuple[str, ...] = (SESSIONS, LIFETIME, WEEK)) -> DataFrame:
    """(kind, value, n, converted) with running totals from the highest value down."""
    values = {
        SESSIONS: F.col("session_count"),
        LIFETIME: F.col("lifetime_days"),
        WEEK: F.unix_date(week_start(F.col("install_timestamp"))),
    }
    entries = F.array(
        *[F.struct(F.lit(k).alias("kind"), values[k].cast("long").alias("value")) for k in kinds]
    )
    hist = (
        facts.select(
            F.inline(entries),
            F.when(F.col("purchase_day") >= 0, 1).otherwise(0).alias("converted"),
        )
        .filter(F.col("value").isNotNull())
        .groupBy("kind", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("converted").alias("converted"))
    )
    return running_total(hist, "value", ["n"], by=["kind"], descending=True, buckets=SMALL)


def _mean(weight: Column) -> Column:
    """Mean of the value over ``weight`` users, one decimal, 0 for an empty band."""
    return F.coalesce(round_to(ratio(F.sum(F.col("value") * weight), F.sum(weight)), 1), F.lit(0.0))


def _of(kind: str, value: Column) -> Column:
    return F.when(F.col("kind") == kind, value)


def _median(kind: str) -> Column:
    return F.percentile(_of(kind, F.col("value")), 0.5, F.col("n"))


def session_metrics() -> dict[str, Column]:
    """Means of the top and bottom bands and of the quartiles, and the median.

    Tied users share a percent rank, so a band may hold far more than 10 % of
    them, or none.
    """
    n = F.col("n")
    in_top = F.when(percent_rank() <= BAND, n).otherwise(0)
    in_bottom = F.when(percent_rank() >= 1 - BAND, n).otherwise(0)
    return {
        "top_10_pct_avg_sessions": _mean(_of(SESSIONS, in_top)),
        "median_user_sessions": F.coalesce(round_to(_median(SESSIONS), 1), F.lit(0.0)),
        "bottom_10_pct_avg_sessions": _mean(_of(SESSIONS, in_bottom)),
        **{
            f"q{q}_avg_sessions": _mean(_of(SESSIONS, ntile_share(q, QUARTILES)))
            for q in range(1, QUARTILES + 1)
        },
    }


def lifetime_metrics() -> dict[str, Column]:
    return {
        "avg_lifetime_days": _mean(_of(LIFETIME, F.col("n"))),
        "max_lifetime_days": F.coalesce(F.max(_of(LIFETIME, F.col("value"))).cast("double"), F.lit(0.0)),
        "median_lifetime_days": F.coalesce(_median(LIFETIME), F.lit(0.0)),
    }


def weekly_metrics() -> dict[str, Column]:
    rate = _of(WEEK, ratio(F.col("converted"), F.col("n")))
    return {
        "weekly_conv_rate_min": F.coalesce(round_to(F.min(rate) * 100, 2), F.lit(0.0)),
        "weekly_conv_rate_max": F.coalesce(round_to(F.max(rate) * 100, 2), F.lit(0.0)),
    }


def _one_row(dist: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    return dist.agg(*[column.alias(name) for name, column in metrics.items()])


def engagement_bands(facts: DataFrame) -> DataFrame:
    return _one_row(distributions(facts, (SESSIONS,)), session_metrics())


def lifetime_stats(facts: DataFrame) -> DataFrame:
    return _one_row(distributions(facts, (LIFETIME,)), lifetime_metrics())


def weekly_conversion(facts: DataFrame) -> DataFrame:
    """(cohort_week, installs, conversions, conversion_pct) per install week."""
    return (
        distributions(facts, (WEEK,))
        .select(
            F.date_from_unix_date(F.col("value").cast("int")).alias("cohort_week"),
            F.col("n").alias("installs"),
            F.col("converted").alias("conversions"),
            round_to(ratio(F.col("converted"), F.col("n")) * 100, 2).alias("conversion_pct"),
        )
        .orderBy("cohort_week")
    )


def advanced_analytics(facts: DataFrame) -> DataFrame:
    """(metric, value): all twelve metrics from one pass over the facts."""
    metrics = {**session_metrics(), **lifetime_metrics(), **weekly_metrics()}
    return _one_row(distributions(facts), metrics).unpivot([], list(metrics), "metric", "value")


def rank_distribution(counts: DataFrame, value: str, tiles: int = QUARTILES) -> DataFrame:
    """RANK, PERCENT_RANK and NTILE of every row, grouped by value and tile.

    Equal to the three windows over all rows ordered by ``value`` descending,
    except that tied rows are counted per tile instead of listed.
    """
    ranked = running_total(histogram(counts, value), value, ["n"], descending=True, buckets=SMALL)
    tile = F.explode(F.sequence(F.lit(1), F.lit(tiles)))
    return (
        ranked.select("*", tile.alias("tile"))
        .select(
            value,
            F.col("tile"),
            (F.col("n_before") + 1).alias("value_rank"),
            percent_rank().alias("pct_rank"),
            ntile_share(F.col("tile"), tiles).alias("n_rows"),
        )
        .filter(F.col("n_rows") > 0)
    )
