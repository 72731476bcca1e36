"""Exact distinct counts that roll up.

The ids of a group become bits: one bitmap of 32,768 bits (4 KB) a group and range of ids. Bitmaps of groups merge into
those of coarser groups by OR, so distinct users a week and channel also give those a week, a channel and in all without
a second look at the rows, and two counts with different filters need no row for each of them.

The ids must be dense, i.e. lie in a range not much larger than their number (number others first, with
``ordering.global_row_number``), and the groups few and large: a group of one id still takes a bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKET = "_ids"


def id_bitmaps(df: DataFrame, by: list[str], number: str, sets: dict[str, Column]) -> DataFrame:
    """Per group and id range a bitmap of the ids for which each condition holds; built before rows move."""
    known = df.filter(F.col(number).isNotNull())
    # ids that a condition leaves out must not set a bit: position null is none
    bits = [F.bitmap_construct_agg(F.when(kept, F.bitmap_bit_position(F.col(number)))).alias(name) for name, kept in sets.items()]
    return known.groupBy(*by, F.bitmap_bucket_number(F.col(number)).alias(BUCKET)).agg(*bits)


def roll_up(bitmaps: DataFrame, by: list[str], sets: list[str]) -> DataFrame:
    """Bitmaps of coarser groups."""
    return bitmaps.groupBy(*by, BUCKET).agg(*[F.bitmap_or_agg(name).alias(name) for name in sets])


def distinct_counts(bitmaps: DataFrame, by: list[str], sets: list[str]) -> DataFrame:
    """Distinct ids of each group in each set."""
    return bitmaps.groupBy(*by).agg(*[F.sum(F.bitmap_count(name)).alias(name) for name in sets])
