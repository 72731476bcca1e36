"""Global ranks, running totals and exact percentiles without a one-task window.

A window without PARTITION BY moves all its rows into one task. Whatever depends
only on the ordering value (rank, percent rank, how many rows of a value fall
into each ntile, percentiles, AUC) is computed here from the value histogram.

Two regimes:

* ``buckets=SMALL``: the caller knows the histogram to be small. Per-user event counts
  qualify (k different counts need at least k*(k-1)/2 events), as do day spans
  and calendar periods. A plain window over the histogram is used.
* otherwise, and by default: the values are unbounded (prices, scores). The
  histogram is written to the shared folder once, cut into value ranges, and each
  range is accumulated in its own task; only the range totals meet in one place.
  Ranges hold about ``RANGE_ROWS`` rows, so their number follows the data.

The ranged forms write the histogram and take its quantiles when they are called,
not when their result is used; :func:`tidemark.sources.staging.release` deletes it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import ratio
from tidemark.sources.staging import stage


SMALL = 0
RANGE_ROWS = 100_000


def range_count(staged: DataFrame, rows: int = RANGE_ROWS) -> int:
    """How many ranges keep each at about ``rows`` rows, 8 at least."""
    return max(8, -(-staged.count() // rows))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(value, n): rows per non-null value; frequent values combine map-side."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def value_ranges(staged: DataFrame, value: str, buckets: int) -> DataFrame:
    """Add ``_range``: which of at most ``buckets`` value ranges the row is in.

    The cut points only balance the work, so approximate quantiles do; equal
    values always share a range.
    """
    cuts = staged.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.5 / buckets)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        return staged.withColumn("_range", F.lit(0.0))
    # Bucketizer compares doubles, so keep it on a double copy of the value.
    return (
        Bucketizer(splits=splits, inputCol="_as_double", outputCol="_range", handleInvalid="keep")
        .transform(staged.withColumn("_as_double", F.col(value).cast("double")))
        .drop("_as_double")
    )


def _range_offsets(
    ranged: DataFrame, totals: list[Column], names: list[str], descending: bool = False
) -> DataFrame:
    """Per range: sum of all earlier ranges (``_offset``) and of all ranges (``_total``)."""
    order = F.col("_range").desc() if descending else F.col("_range").asc()
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranged.groupBy("_range")
        .agg(*totals)
        .select(
            "_range",
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_offset") for n in names],
            *[F.sum(n).over(everything).alias(f"{n}_total") for n in names],
        )
    )


def running_total(
    hist: DataFrame,
    value: str,
    sums: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``<sum>_before``, the total of each column over strictly earlier values,
    and ``<sum>_total``, its total over all values.

    ``hist`` has one row per value (per ``by`` group when given; groups need the
    small-histogram regime).
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    by = by or []
    if buckets == SMALL:
        earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return hist.select(
            "*",
            *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in sums],
            *[F.sum(s).over(Window.partitionBy(*by)).alias(f"{s}_total") for s in sums],
        )
    if by:
        raise ValueError("grouped running totals need a small histogram (buckets=SMALL)")
    stored = stage(hist, "histogram")
    ranged = value_ranges(stored, value, buckets or range_count(stored))
    offsets = _range_offsets(ranged, [F.sum(s).alias(s) for s in sums], sums, descending)
    earlier = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # a row per range
    return ranged.join(offsets, "_range").select(
        *hist.columns,
        *[
            (F.coalesce(F.sum(s).over(earlier), F.lit(0)) + F.col(f"{s}_offset")).alias(f"{s}_before")
            for s in sums
        ],
        *[F.col(f"{s}_total") for s in sums],
    )


def global_row_number(df: DataFrame, order_by: str, name: str, buckets: int | None = None) -> DataFrame:
    """Dense 1..n numbering by a unique numeric column, each range in its own task."""
    stored = stage(df, "numbering")
    ranged = value_ranges(stored, order_by, buckets or range_count(stored))
    offsets = _range_offsets(ranged, [F.count(F.lit(1)).alias("n")], ["n"])
    within = Window.partitionBy("_range").orderBy(F.col(order_by).asc())
    return ranged.join(offsets, "_range").select(
        (F.row_number().over(within) + F.col("n_offset")).alias(name), *df.columns
    )


def rank_in_class_by_hash(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Random but reproducible position of every row inside its class.

    Adds ``class_rank`` (1..n_class) and ``class_size``. The order is the MD5 of
    "seed:key", ties broken by key. A class may hold most of the rows, so it is
    cut by the first three hex digits of the hash: 4,096 even slices per class,
    sorted in parallel and then shifted by the sizes of the earlier slices.
    """
    hashed = df.withColumn(
        "_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ).withColumn("_slice", F.substring("_hash", 1, 3))
    earlier = Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most 4,096 rows per class
    slices = (
        hashed.groupBy(label, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            label,
            "_slice",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
            F.sum("_n").over(Window.partitionBy(label)).alias("class_size"),
        )
    )
    within = Window.partitionBy(label, "_slice").orderBy("_hash", key)
    return hashed.join(slices, [label, "_slice"]).select(
        *df.columns,
        (F.row_number().over(within) + F.col("_offset")).alias("class_rank"),
        "class_size",
    )


def percent_rank() -> Column:
    """Percent rank of a histogram value from ``n_before`` and ``n_total``."""
    return F.coalesce(ratio(F.col("n_before"), F.col("n_total") - 1), F.lit(0.0))


def ntile_share(tile: Column | int, tiles: int) -> Column:
    """How many rows of a histogram value land in ntile ``tile`` (1-based).

    NTILE gives the first ``n_total % tiles`` tiles one extra row; the rows of a
    value occupy positions [n_before, n_before + n), so its share is the overlap
    of two intervals.
    """
    tile = F.lit(tile) if isinstance(tile, int) else tile
    base = F.floor(F.col("n_total") / F.lit(tiles))
    extra = F.col("n_total") % F.lit(tiles)
    start = (tile - 1) * base + F.least(tile - 1, extra)
    end = tile * base + F.least(tile, extra)
    first, behind_last = F.col("n_before"), F.col("n_before") + F.col("n")
    return F.greatest(F.lit(0), F.least(behind_last, end) - F.greatest(first, start))


def exact_percentiles(
    df: DataFrame, value: str, probabilities: dict[str, float], buckets: int | None = None
) -> DataFrame:
    """One row of linear-interpolated percentiles of an unbounded numeric column.

    The totals of the value ranges tell which ranges hold the wanted positions; only these, two per percentile at most,
    are put in order. The value at sorted position k is the largest one with at most k rows before it.
    """
    stored = stage(histogram(df, value), "histogram")
    ranged = value_ranges(stored, value, buckets or range_count(stored))
    offsets = _range_offsets(ranged, [F.sum("n").alias("n")], ["n"]).join(ranged.groupBy("_range").agg(F.sum("n").alias("_rows")), "_range")
    last = F.col("n_total") - 1
    positions = [side(F.lit(p) * last) for p in probabilities.values() for side in (F.floor, F.ceil)]
    held = reduce(or_, [(F.col("n_offset") <= k) & (k < F.col("n_offset") + F.col("_rows")) for k in positions], F.lit(False))
    wanted = ranged.join(offsets.filter(held), "_range")
    earlier = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = wanted.select(
        value, "n_total", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.col("n_offset")).alias("n_before")
    )

    def at(position: Column) -> Column:
        return F.max(F.when(F.col("n_before") <= position, F.col(value).cast("double")))

    bounds = ranked.agg(
        F.max(last).alias("last"),
        *[at(F.floor(F.lit(p) * last)).alias(f"{name}_low") for name, p in probabilities.items()],
        *[at(F.ceil(F.lit(p) * last)).alias(f"{name}_high") for name, p in probabilities.items()],
    )

    def between(name: str, p: float) -> Column:
        position = F.lit(p) * F.col("last")
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return bounds.select(*[between(name, p) for name, p in probabilities.items()])
