"""State changes as table transforms: current frames and input in, new frames out.

Callers write the results. `as_of` is always explicit. The list of changes that
several result frames share is pinned once; while it is short it is broadcast,
so that a few changes do not shuffle a large table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.functions.scalars import iso_text, millis_between, parse_float, trim_all
from stockyard.operators.frames import Frames
from stockyard.operators.outbox import payment_failed_payload, payment_success_payload
from stockyard.operators.sizing import broadcast_when, is_small
from stockyard.session import store


def last_changes(changes: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the values of its last change in `order`; equal places go by the values themselves.

    A key that is changed over and over is reduced in the tasks before it is shuffled.
    """
    place = F.struct(*order, *values)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values), place).alias("_last")).select(*keys, "_last.*")


def upsert(
    current: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    updates: Sequence[str],
    inserts: Mapping[str, Column],
    order: Sequence[str] = (),
) -> DataFrame:
    """Insert-or-update on unique `keys`.

    `updates` are taken from `incoming`; other columns keep their value, or on a
    new row take the one given in `inserts`. Of several incoming rows of one key
    the last in `order` counts.
    """
    last = last_changes(incoming, keys, updates, order)
    new = last.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in updates], F.lit(True).alias("_in"))
    old = current.withColumn("_old", F.lit(True))
    merged = old.join(new, list(keys), "full")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        kind = current.schema[c].dataType
        if c in updates:
            return F.when(F.col("_in"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(kind).alias(c)
        return F.when(F.col("_old"), F.col(c)).otherwise(inserts.get(c, F.lit(None))).cast(kind).alias(c)

    return merged.select(*[value(c) for c in current.columns])


def _with_status(sales: DataFrame, changed: DataFrame, status: str) -> DataFrame:
    """Sales whose id is in `changed` take `status`."""
    mark = changed.select("id", F.lit(status).alias("_status"))
    return sales.join(mark, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def sales_due_to_start(sales: DataFrame, sale_products: DataFrame, as_of: Column) -> DataFrame:
    due = sales.filter((F.col("status") == "SCHEDULED") & (F.col("start_time") <= as_of))
    return due.join(sale_products.select(F.col("sale_id").alias("id")), "id", "left_semi")


def sales_due_to_end(sales: DataFrame, as_of: Column) -> DataFrame:
    return sales.filter((F.col("status") == "ACTIVE") & (F.col("end_time") <= as_of))


def _lines_of(sale_products: DataFrame, sales: DataFrame) -> DataFrame:
    return sale_products.join(sales.select(F.col("id").alias("sale_id")), "sale_id", "left_semi")


def _opened_counters(lines: DataFrame, counters: DataFrame) -> DataFrame:
    fresh = store(lines.select(F.col("id").alias("sale_product_id"), F.col("total_qty").alias("live_qty")))
    ids = broadcast_when(is_small(fresh), fresh.select("sale_product_id"))
    return counters.join(ids, "sale_product_id", "left_anti").unionByName(fresh)


def activate_sales(sales, sale_products, counters, as_of: Column) -> Frames:
    """Due SCHEDULED sales with products become ACTIVE and their counters are set to the stock.

    `cache` holds the entry of each started sale and how long it is kept: until
    an hour after the end.
    """
    due = sales_due_to_start(sales, sale_products, as_of)
    seconds_left = F.floor(millis_between(F.col("end_time"), as_of) / 1000)
    return Frames(
        sales=lambda: _with_status(sales, due, "ACTIVE"),
        counters=lambda: _opened_counters(_lines_of(sale_products, due), counters),
        cache=lambda: due.select(
            "id",
            "name",
            F.lit("ACTIVE").alias("status"),
            iso_text(F.col("end_time")).alias("end_time"),
            (seconds_left + 3600).cast("bigint").alias("ttl_s"),
        ),
    )


def settle_ended_sales(sales, sale_products, inventory, counters, as_of: Column) -> Frames:
    """Due ACTIVE sales become ENDED; their counters are written back to the tables and dropped."""
    due = sales_due_to_end(sales, as_of)

    @cache
    def left() -> DataFrame:
        last = store(
            _lines_of(sale_products, due)
            .select(F.col("id").alias("sale_product_id"))
            .join(counters, "sale_product_id")
            .withColumnRenamed("live_qty", "_left")
        )
        return broadcast_when(is_small(last), last)

    counted = F.col("_left").isNotNull()

    def settled() -> DataFrame:
        taken = F.greatest(F.lit(0), F.col("total_qty") - F.col("_left"))
        return (
            sale_products.join(left().withColumnRenamed("sale_product_id", "id"), "id", "left")
            .withColumn("reserved_qty", F.when(counted, taken).otherwise(F.col("reserved_qty")))
            .drop("_left")
        )

    def synced() -> DataFrame:
        level = F.greatest(F.lit(0), F.col("_left"))
        return (
            inventory.join(left(), "sale_product_id", "left")
            .withColumn("available_qty", F.when(counted, level).otherwise(F.col("available_qty")))
            .withColumn("last_synced_at", F.when(counted, as_of).otherwise(F.col("last_synced_at")))
            .drop("_left")
        )

    return Frames(
        sales=lambda: _with_status(sales, due, "ENDED"),
        sale_products=settled,
        inventory=synced,
        counters=lambda: counters.join(left().select("sale_product_id"), "sale_product_id", "left_anti"),
    )


def advance_sales(sales, sale_products, inventory, counters, as_of: Column) -> Frames:
    """One scheduler tick; both selections read the state before it.

    A SCHEDULED sale that has already lapsed thus starts in this tick and ends in the next.
    """
    starting = sales_due_to_start(sales, sale_products, as_of)
    ended = settle_ended_sales(sales, sale_products, inventory, counters, as_of)
    return Frames(
        sales=lambda: _with_status(ended["sales"], starting, "ACTIVE"),
        sale_products=lambda: ended["sale_products"],
        inventory=lambda: ended["inventory"],
        counters=lambda: _opened_counters(_lines_of(sale_products, starting), ended["counters"]),
    )


def feed_sale_status(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sale_id, status) of every sale whose status changed."""
    old = before.select("id", F.col("status").alias("_old"))
    return (
        after.join(old, "id").filter(F.col("status") != F.col("_old")).select(F.col("id").alias("sale_id"), "status")
    )


def cancel_sales(sales: DataFrame, requests: DataFrame) -> DataFrame:
    """SCHEDULED sales named in `requests` (sale_id) become ENDED."""
    asked = sales.filter("status = 'SCHEDULED'").join(
        requests.select(F.col("sale_id").alias("id")), "id", "left_semi"
    )
    return _with_status(sales, asked, "ENDED")


def upsert_sale_products(
    sale_products, inventory, changes, as_of: Column, new_id: Column, order: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Price and stock per (sale, product) are replaced, reserved_qty stays, inventory follows the stock.

    Several changes of one line apply in `order`, so the last one stands.
    """
    merged = upsert(
        sale_products,
        changes,
        ["sale_id", "product_id"],
        ["sale_price", "total_qty"],
        {"id": new_id, "reserved_qty": F.lit(0)},
        order,
    )
    touched = merged.join(changes.select("sale_id", "product_id"), ["sale_id", "product_id"], "left_semi")
    levels = touched.select(
        F.col("id").alias("sale_product_id"), F.col("total_qty").alias("available_qty"), as_of.alias("last_synced_at")
    )
    stock = upsert(
        inventory,
        levels,
        ["sale_product_id"],
        ["available_qty", "last_synced_at"],
        {"id": F.col("sale_product_id")},
    )
    return {"sale_products": merged, "inventory": stock}


def remove_sale_products(sales, sale_products, inventory, removals) -> dict[str, DataFrame]:
    """Drop (sale_id, sale_product_id) pairs of SCHEDULED sales, with their inventory rows."""
    open_sales = sales.filter("status = 'SCHEDULED'").select(F.col("id").alias("sale_id"))
    granted = removals.join(open_sales, "sale_id", "left_semi").select(
        F.col("sale_product_id").alias("id"), "sale_id"
    )
    gone = sale_products.join(granted, ["id", "sale_id"], "left_semi").select("id")
    return {
        "sale_products": sale_products.join(gone, "id", "left_anti"),
        "inventory": inventory.join(
            gone.select(F.col("id").alias("sale_product_id")), "sale_product_id", "left_anti"
        ),
    }


PATCHABLE = ("name", "description", "base_price", "is_active", "image_key")


def patch_products(products: DataFrame, patches: DataFrame, order: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Partial updates; a field changes only where its `has_<field>` flag is set.

    Patches hold text fields. One with a bad price or without any field is
    rejected as a whole, as is one for an unknown product. Several patches of a
    product apply in `order`: each field has the value of the last patch that sets it.
    """
    flags = {f: F.coalesce(F.col(f"has_{f}"), F.lit(False)) for f in PATCHABLE}
    price = parse_float(F.col("base_price"))
    any_field = flags["name"] | flags["description"] | flags["base_price"] | flags["is_active"] | flags["image_key"]
    known = products.select("id", F.lit(True).alias("_known"))
    checked = patches.join(known, "id", "left").withColumn(
        "error_code",
        F.when(F.col("_known").isNull(), "PRODUCT_NOT_FOUND")
        .when(flags["base_price"] & (price.isNull() | (price <= 0)), "INVALID_PRICE")
        .when(~any_field, "NO_FIELDS"),
    )
    values = {
        "name": trim_all(F.col("name")),
        "description": trim_all(F.col("description")),
        "base_price": price.try_cast("decimal(10,2)"),
        "is_active": F.coalesce(F.col("is_active") == "true", F.lit(False)),
        "image_key": F.col("image_key"),
    }
    good = checked.filter("error_code IS NULL").select(
        "id",
        F.struct(*order).alias("_at") if order else F.lit(0).alias("_at"),
        *[F.when(flags[f], F.struct(values[f].alias("v"))).alias(f"_set_{f}") for f in PATCHABLE],
    )
    # max_by skips patches without the field, whose place is then NULL.
    good = good.groupBy("id").agg(
        *[
            F.max_by(f"_set_{f}", F.when(F.col(f"_set_{f}").isNotNull(), F.struct("_at", f"_set_{f}"))).alias(f"_set_{f}")
            for f in PATCHABLE
        ]
    )
    good = good.select(
        "id",
        *[F.col(f"_set_{f}").isNotNull().alias(f"_has_{f}") for f in PATCHABLE],
        *[F.col(f"_set_{f}.v").alias(f"_to_{f}") for f in PATCHABLE],
    )
    patched = products.join(good, "id", "left").select(
        *[
            F.when(F.col(f"_has_{c}"), F.col(f"_to_{c}")).otherwise(F.col(c)).alias(c) if c in PATCHABLE else F.col(c)
            for c in products.columns
        ]
    )
    return {"products": patched, "rejected": checked.filter("error_code IS NOT NULL").select("id", "error_code")}


def deactivate_products(products: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Soft delete by id; only active products change, others are rejected."""
    live = products.filter("is_active").select("id")
    hit = live.join(requests.select("id"), "id", "left_semi").withColumn("_off", F.lit(True))
    return {
        "products": products.join(hit, "id", "left")
        .withColumn("is_active", F.col("is_active") & F.col("_off").isNull())
        .drop("_off"),
        "rejected": requests.join(live, "id", "left_anti").select(
            "id", F.lit("NOT_FOUND_OR_INACTIVE").alias("error_code")
        ),
    }


def move_counters(counters: DataFrame, moves: DataFrame, create: bool = False, few: bool = False) -> DataFrame:
    """Add `n` per sale_product_id; a missing counter is left missing, or made when `create`.

    `few` says that the moves were counted and are few enough to broadcast.
    """
    summed = moves.groupBy("sale_product_id").agg(F.sum("n").alias("_n"))
    summed = broadcast_when(few and not create, summed)
    joined = counters.join(summed, "sale_product_id", "full" if create else "left")
    level = F.coalesce("live_qty", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return joined.select("sale_product_id", level.cast("int").alias("live_qty"))


def give_back_reserved(sale_products: DataFrame, failed: DataFrame, few: bool = False) -> DataFrame:
    """Lower reserved_qty by the failed quantities, not below zero.

    All moves are decrements, so one clamped sum equals clamping one by one.
    `few` says that the failed lines were counted and are few enough to broadcast.
    """
    freed = failed.groupBy(F.col("sale_product_id").alias("id")).agg(F.sum("quantity").alias("_q"))
    freed = broadcast_when(few, freed)
    return (
        sale_products.join(freed, "id", "left")
        .withColumn(
            "reserved_qty",
            F.when(
                F.col("_q").isNotNull(), F.greatest(F.lit(0), F.col("reserved_qty") - F.col("_q"))
            ).otherwise(F.col("reserved_qty")).cast("int"),
        )
        .drop("_q")
    )


def apply_payment_outcomes(
    orders: DataFrame,
    sale_products: DataFrame,
    counters: DataFrame,
    messages: DataFrame,
    outcomes: DataFrame,
    as_of: Column,
    units: str = "per_order",
    release_creates: bool = False,
) -> dict[str, DataFrame]:
    """Settle PENDING orders; repeated deliveries and other orders are skipped.

    `messages`: order_id, user_id, sale_product_id, quantity, total_amount,
    product_name; a message delivered again counts once. `outcomes`: order_id, delivery_id, success,
    transaction_id, reason; the lowest delivery_id of an order decides.
    """
    first = outcomes.groupBy("order_id").agg(
        F.min_by(F.struct("success", "transaction_id", "reason"), "delivery_id").alias("_o")
    ).select("order_id", "_o.*")
    pending = orders.filter("status = 'PENDING'").select(F.col("id").alias("order_id"))
    fields = [c for c in messages.columns if c != "order_id"]
    messages = messages.groupBy("order_id").agg(F.min(F.struct(*fields)).alias("_m")).select("order_id", "_m.*")
    settled = store(messages.join(first, "order_id").join(pending, "order_id", "left_semi"))
    few = is_small(settled)
    result = settled.select(
        F.col("order_id").alias("id"), F.when(F.col("success"), "CONFIRMED").otherwise("FAILED").alias("_status")
    )
    updated = (
        orders.join(broadcast_when(few, result), "id", "left")
        .withColumn("updated_at", F.when(F.col("_status").isNotNull(), as_of).otherwise(F.col("updated_at")))
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status")
    )
    failed = settled.filter("NOT success")
    events = settled.select(
        F.when(F.col("success"), "PAYMENT_SUCCESS").otherwise("PAYMENT_FAILED").alias("event_type"),
        F.when(F.col("success"), payment_success_payload())
        .otherwise(payment_failed_payload(F.col("reason")))
        .alias("payload"),
        F.col("order_id").alias("event_key"),
    )
    moved = failed.select(
        "sale_product_id", (F.lit(1) if units == "per_order" else F.col("quantity")).alias("n")
    )
    return {
        "orders": updated,
        "sale_products": give_back_reserved(sale_products, failed, few),
        "outbox": events,
        "counters": move_counters(counters, moved, release_creates, few),
        "settled": result.withColumnRenamed("id", "order_id").withColumnRenamed("_status", "status"),
        "moves": failed.select("order_id", "sale_product_id", "quantity"),
    }
