"""Reconciliation of live counters, stuck orders, inventory and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.operators.outbox import stuck_order_payload
from stockyard.operators.reports import join_order_line_to_sale_product
from stockyard.operators.sizing import broadcast_when, is_small
from stockyard.operators.transitions import give_back_reserved, move_counters
from stockyard.schemas import LIVE_ORDER_STATUSES
from stockyard.session import store

STUCK_AFTER = "INTERVAL 15 MINUTES"
STALE_AFTER = "INTERVAL 10 MINUTES"


def _older(column: str, as_of: Column, age: str) -> Column:
    return F.col(column) < as_of - F.expr(age)


def inventory_discrepancies(
    sales, sale_products, products, orders, order_items, counters, units: str = "lines"
) -> DataFrame:
    """Counters of ACTIVE sales that differ from stock less live orders.

    Live orders count by line, or by quantity with units="quantity". All sales
    are checked in one job, and only orders of ACTIVE sales are read into it.
    """
    active = sales.filter("status = 'ACTIVE'").select(F.col("id").alias("sale_id"))
    lines = sale_products.join(active, "sale_id", "left_semi").select(
        F.col("id").alias("sale_product_id"), "sale_id", "product_id", "total_qty"
    )
    live = orders.filter(F.col("status").isin(*LIVE_ORDER_STATUSES)).join(active, "sale_id", "left_semi").select(
        F.col("id").alias("order_id"), "sale_id"
    )
    taken = (
        order_items.select("order_id", "product_id", "quantity")
        .join(live, "order_id")
        .groupBy("sale_id", "product_id")
        .agg((F.count("*") if units == "lines" else F.sum("quantity")).alias("_taken"))
    )
    expected = F.col("total_qty") - F.coalesce("_taken", F.lit(0))
    diff = F.col("expected_qty") - F.col("live_qty")
    return (
        lines.join(taken, ["sale_id", "product_id"], "left")
        .withColumn("expected_qty", expected.cast("bigint"))
        .join(counters, "sale_product_id")
        .filter(diff != 0)
        .join(products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), "product_id")
        .select(
            F.when(diff > 0, "ORPHANED_DECREMENT").otherwise("OVER_RELEASE").alias("issue"),
            "sale_id",
            "sale_product_id",
            "product_name",
            "live_qty",
            "expected_qty",
            F.abs(diff).alias("delta"),
        )
    )


def repair_counters(counters: DataFrame, issues: DataFrame, few: bool = False) -> DataFrame:
    """Counters with an issue are moved to the expected level."""
    fixed = issues.select("sale_product_id", F.col("expected_qty").cast("int").alias("_fixed"))
    fixed = broadcast_when(few, fixed)
    return counters.join(fixed, "sale_product_id", "left").select(
        "sale_product_id", F.coalesce("_fixed", "live_qty").alias("live_qty")
    )


def stuck_pending_orders(orders, order_items, sale_products, as_of: Column) -> DataFrame:
    """Lines of orders that have been PENDING for more than 15 minutes."""
    stuck = orders.filter((F.col("status") == "PENDING") & _older("created_at", as_of, STUCK_AFTER))
    return join_order_line_to_sale_product(stuck, order_items, sale_products)


def fail_stuck_orders(orders, order_items, sale_products, counters, as_of: Column) -> dict[str, DataFrame]:
    """Stuck orders fail; their units go back to reserved_qty and to existing counters, one event per line.

    The stuck lines are pinned, since every result frame comes from them.
    """
    lines = store(stuck_pending_orders(orders, order_items, sale_products, as_of))
    few = is_small(lines)
    failed = lines.select(F.col("order_id").alias("id"), F.lit(True).alias("_stuck")).distinct()
    hit = F.col("_stuck").isNotNull()
    updated = (
        orders.join(broadcast_when(few, failed), "id", "left")
        .withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
        .withColumn("status", F.when(hit, "FAILED").otherwise(F.col("status")))
        .drop("_stuck")
    )
    events = lines.select(
        F.lit("PAYMENT_FAILED").alias("event_type"),
        stuck_order_payload().alias("payload"),
        F.col("item_id").cast("string").alias("event_key"),
    )
    return {
        "orders": updated,
        "sale_products": give_back_reserved(sale_products, lines, few),
        "outbox": events,
        "counters": move_counters(
            counters, lines.select("sale_product_id", F.col("quantity").alias("n")), few=few
        ),
        "fixed": lines.select("order_id"),
    }


def sync_inventory(sales, sale_products, inventory, counters, as_of: Column) -> DataFrame:
    """Inventory rows of ACTIVE sales take the level of their counter, where there is one."""
    active = sales.filter("status = 'ACTIVE'").select(F.col("id").alias("sale_id"))
    level = (
        sale_products.join(active, "sale_id", "left_semi")
        .select(F.col("id").alias("sale_product_id"))
        .join(counters.withColumnRenamed("live_qty", "_live"), "sale_product_id")
    )
    return (
        inventory.join(level, "sale_product_id", "left")
        .withColumn("available_qty", F.coalesce("_live", "available_qty"))
        .withColumn("last_synced_at", F.when(F.col("_live").isNotNull(), as_of).otherwise(F.col("last_synced_at")))
        .drop("_live")
    )


def stale_outbox(outbox: DataFrame, as_of: Column) -> DataFrame:
    """Unpublished events older than 10 minutes, by type."""
    old = outbox.filter(~F.col("published") & _older("created_at", as_of, STALE_AFTER))
    return old.groupBy("event_type").agg(F.count("*").alias("stale_events"))


def reconcile_run(
    sales, sale_products, products, orders, order_items, inventory, counters, outbox, as_of: Column, outbox_as_of=None
) -> dict[str, DataFrame]:
    """Stuck orders, then counters on the updated state, then inventory, then the event log.

    `summary` is one row: stuck_fixed, discrepancies, stale_events, has_issues.
    """
    repaired = fail_stuck_orders(orders, order_items, sale_products, counters, as_of)
    issues = store(
        inventory_discrepancies(
            sales, repaired["sale_products"], products, repaired["orders"], order_items, repaired["counters"]
        )
    )
    counters_now = repair_counters(repaired["counters"], issues, is_small(issues))
    stale = stale_outbox(outbox, outbox_as_of if outbox_as_of is not None else as_of)
    counted = [
        repaired["fixed"].agg(F.count("*").alias("stuck_fixed")),
        issues.agg(F.count("*").alias("discrepancies")),
        stale.agg(F.coalesce(F.sum("stale_events"), F.lit(0)).alias("stale_events")),
    ]
    rows = counted[0]
    for row in counted[1:]:
        rows = rows.unionByName(row, allowMissingColumns=True)
    names = ["stuck_fixed", "discrepancies", "stale_events"]
    summary = rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).withColumn(
        "has_issues", (F.col("stuck_fixed") + F.col("discrepancies") + F.col("stale_events")) > 0
    )
    return {
        "orders": repaired["orders"],
        "sale_products": repaired["sale_products"],
        "outbox": repaired["outbox"],
        "issues": issues,
        "counters": counters_now,
        "inventory": sync_inventory(sales, repaired["sale_products"], inventory, counters_now, as_of),
        "stale": stale,
        "summary": summary,
    }
