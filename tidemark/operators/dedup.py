"""Keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def keep_first(df: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """One row per key, the one with the smallest ``order_by``.

    A minimum over (order, row) is combined before the shuffle, so a name shared
    by a third of the rows costs one row per task, where a row_number window
    would sort all of them in one task.
    """
    rest = [c for c in df.columns if c != order_by]
    first = F.min(F.struct(order_by, *rest)).alias("_first")
    return df.groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(first).select(
        *[F.col(f"_first.{c}").alias(c) for c in df.columns]
    )
