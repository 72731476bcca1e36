"""Cleaning of the raw app catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numeric import to_number
from tidemark.operators.dedup import keep_first
from tidemark.operators.ordering import global_row_number

CATEGORY = "PRODUCTIVITY"
MIN_RATING = 4.0


def catalog_clean(
    raw: DataFrame, category: str = CATEGORY, min_rating: float = MIN_RATING, buckets: int | None = None
) -> DataFrame:
    """Typed, filtered, deduplicated apps with ids 1..n in source order.

    ``raw`` holds text columns and ``source_order``. Of apps with one name the
    first that passes the filters is kept.
    """
    parsed = raw.filter(F.translate("Installs", "+,", "") != "Free").select(
        "source_order",
        "App",
        "Category",
        to_number(F.col("Rating")).alias("Rating"),
        to_number(F.col("Installs"), "+,").cast("long").alias("Installs"),
        to_number(F.col("Price"), "$").alias("Price"),
    )
    kept = parsed.dropna(subset=["Rating", "Installs"]).filter(
        (F.col("Category") == category) & (F.col("Rating") >= min_rating)
    )
    numbered = global_row_number(keep_first(kept, ["App"], "source_order"), "source_order", "app_id", buckets)
    return numbered.select(
        F.col("app_id").cast("int").alias("app_id"),
        F.col("App").alias("app_name"),
        F.col("Category").alias("category"),
        "Rating",
        "Installs",
        "Price",
    )
