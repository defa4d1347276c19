"""Snapshots of live stock counters; a missing key is a missing row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_live_qty(df: DataFrame, counters: DataFrame) -> DataFrame:
    """Add `live_qty` by sale_product_id, NULL where there is no counter."""
    return df.join(counters.select("sale_product_id", "live_qty"), "sale_product_id", "left")
