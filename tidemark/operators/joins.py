"""Joins and id-set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


KEYLESS_SALTS = 1 << 16


def salted_left_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: Column, salts: int | Column = 16
) -> DataFrame:
    """Left join whose left side may hold a very frequent key.

    Left rows of one key are spread over ``salts`` shuffle buckets by a hash of
    ``spread_by``; rows without a key match nothing and are spread apart from them.
    The right side, which must be small relative to the left and
    unique on ``key``, is repeated once per salt. When Spark measures the right
    side as small it still broadcasts it, and adaptive execution may split the
    buckets further.
    """
    salts = F.lit(salts) if isinstance(salts, int) else salts
    spread = F.xxhash64(spread_by)
    salt = F.when(F.col(key).isNull(), F.pmod(spread, F.lit(KEYLESS_SALTS))).otherwise(F.pmod(spread, salts))
    salted = left.withColumn("_salt", salt.cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)))
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")


def id_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of ``left - right``, ``right - left`` and the intersection of two id sets.

    One flag aggregate instead of three joins: a key that is frequent on either
    side is combined before the shuffle.
    """
    tagged = left.select(key, F.lit(1).alias("side")).unionByName(
        right.select(key, F.lit(2).alias("side"))
    )
    sides = tagged.filter(F.col(key).isNotNull()).groupBy(key).agg(F.bit_or("side").alias("sides"))
    return sides.agg(
        F.count_if(F.col("sides") == 1).alias("only_left"),
        F.count_if(F.col("sides") == 2).alias("only_right"),
        F.count_if(F.col("sides") == 3).alias("in_both"),
    )
