"""Stock levels replayed from reserve and release events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.operators.blocks import range_blocks, running_totals
from stockyard.operators.levels import quantity_levels


def stock_ledger(
    events: DataFrame,
    totals: DataFrame,
    key: Sequence[str],
    units: str = "per_order",
    release_creates: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """Level after each event; events have key, ts, id and delta (-n reserve, +n release).

    A reserve is refused at 0 or below. Refused units are the amount by which the
    running sum would fall below zero, so the level is P - min(0, lowest P so
    far) with P the running sum from the opening stock. That is one prefix sum
    and one prefix minimum, which `running_totals` takes over blocks of a hot key.

    A key without opening stock has no counter: reserves say SALE_NOT_FOUND and
    releases are ignored, or make a counter when `release_creates`.
    With units="quantity" whole quantities move and a reserve needs all of them; that
    is no prefix sum, see `levels.quantity_levels`.
    """
    opening = totals.select(*key, "total_qty")
    if units == "quantity":
        return quantity_levels(events, opening, key, release_creates, blocks)
    one = events.select(*key, "ts", "id", "delta", F.signum("delta").cast("int").alias("_unit"))
    summed = running_totals(range_blocks(one, key, ["ts", "id"], blocks), key, "_unit")
    if release_creates:
        released = F.when(F.col("_unit") > 0, 1).otherwise(0)
        summed = running_totals(summed.withColumn("_released", released), key, "_released", "_releases", "_unused")
    start = F.coalesce("total_qty", F.lit(0))
    now = start + F.col("run_sum")
    lowest_before = F.least(F.lit(0), start, start + F.col("low_before"))
    level_before = now - F.col("_unit") - lowest_before
    refused = (F.col("_unit") < 0) & (level_before <= 0)
    has_counter = F.col("total_qty").isNotNull()
    if release_creates:
        has_counter = has_counter | (F.col("_releases") > 0)
    level = F.when(has_counter, F.when(refused, level_before).otherwise(level_before + F.col("_unit")))
    reason = F.when(F.col("_unit") < 0, F.when(~has_counter, "SALE_NOT_FOUND").when(refused, "OUT_OF_STOCK"))
    return summed.join(opening, list(key), "left").select(
        *key,
        "ts",
        "id",
        "delta",
        level.cast("int").alias("level"),
        (has_counter & ~refused).alias("success"),
        reason.alias("reason"),
    )


def feed_inventory_changes(ledger: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per event that changed a counter."""
    return ledger.filter("success").select(*key, "ts", "id", F.col("level").alias("available_qty"))
