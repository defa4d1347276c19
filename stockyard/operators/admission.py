"""Order admission replayed over a request log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.functions.scalars import to_money
from stockyard.operators.blocks import last_values, range_blocks, row_numbers
from stockyard.operators.limits import limit_chain
from stockyard.operators.outbox import order_created_payload
from stockyard.operators.replay import replay, row_by_row
from stockyard.operators.rules import dq_order_requests
from stockyard.session import store
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

PRODUCT = ["sale_id", "product_id"]


def idempotent_dedupe(requests: DataFrame, key: str = "idempotency_key", ts: str = "ts", id_: str = "id") -> DataFrame:
    """Add first_id (the request that owns the key) and is_duplicate.

    A request without a key owns itself. The owner is an aggregate, so a key with
    very many repeats is combined before the shuffle.
    """
    keyed = requests.withColumn("_key", F.coalesce(F.col(key), F.concat(F.lit("request:"), F.col(id_).cast("string"))))
    first = keyed.groupBy("_key").agg(F.min(F.struct(ts, id_)).getField(id_).alias("first_id"))
    return (
        keyed.join(first, "_key").withColumn("is_duplicate", F.col(id_) != F.col("first_id")).drop("_key")
    )


def sale_status_at(ts: Column, start: Column, end: Column, cancelled: Column, has_products: Column) -> Column:
    return (
        F.when(cancelled, "ENDED")
        .when((ts < start) | ~has_products, "SCHEDULED")
        .when(ts >= end, "ENDED")
        .otherwise("ACTIVE")
    )


def gate_sale_and_product(requests: DataFrame, sales: DataFrame, sale_products: DataFrame) -> DataFrame:
    """Add sale_status at the request's time and the gate that stops it, NULL when none.

    `sales` may carry a `cancelled` flag. A sale without products never starts.
    """
    if "cancelled" not in sales.columns:
        sales = sales.withColumn("cancelled", F.lit(False))
    stocked = sale_products.select(F.col("sale_id").alias("id")).distinct().withColumn("_stocked", F.lit(True))
    times = sales.join(stocked, "id", "left").select(
        F.col("id").alias("sale_id"),
        "start_time",
        "end_time",
        F.coalesce("cancelled", F.lit(False)).alias("cancelled"),
        F.coalesce("_stocked", F.lit(False)).alias("_stocked"),
    )
    offered = sale_products.select(*PRODUCT, F.lit(True).alias("_offered"))
    joined = requests.join(times, "sale_id", "left").join(offered, PRODUCT, "left")
    status = F.when(
        F.col("start_time").isNotNull(),
        sale_status_at(
            F.col("ts"), F.col("start_time"), F.col("end_time"), F.col("cancelled"), F.col("_stocked")
        ),
    )
    gate = (
        F.when(F.col("sale_status").isNull(), "SALE_NOT_FOUND")
        .when(F.col("sale_status") != "ACTIVE", "SALE_NOT_ACTIVE")
        .when(F.col("_offered").isNull(), "PRODUCT_NOT_IN_SALE")
    )
    return (
        joined.withColumn("sale_status", status)
        .withColumn("gate", gate)
        .drop("start_time", "end_time", "cancelled", "_stocked", "_offered")
    )


def gate_as_of(
    requests: DataFrame, changes: DataFrame, sale_products: DataFrame, id_: str = "request_id", blocks: int | None = None
) -> DataFrame:
    """The gate against the status that the feed of changes had told by the time of each request.

    `changes` has sale_id, changed_at, seq and status, any number per sale; a change at the
    request's instant counts, of several at one instant the one of the largest seq. A sale
    without a change so far is not known. Requests and changes are laid out together by sale
    and time in blocks, so neither a sale with a third of the requests nor one that changes
    all the time is one task, and the last status is a scan.
    """
    request = F.struct(*requests.columns)
    told = changes.select(
        "sale_id", F.col("changed_at").alias("at"), F.lit(0).alias("kind"), F.col("seq").cast("bigint").alias("place"), "status"
    ).withColumn("request", F.lit(None).cast(requests.select(request.alias("r")).schema["r"].dataType))
    asked = requests.select(
        "sale_id", F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col(id_).cast("bigint").alias("place"), F.lit(None).cast("string").alias("status"), request.alias("request")
    )
    blocked = range_blocks(told.unionByName(asked), ["sale_id"], ["at", "kind", "place"], blocks)
    known = last_values(blocked, ["sale_id"], "status", "sale_status").filter("kind = 1").select("request.*", "sale_status")
    offered = sale_products.select(*PRODUCT, F.lit(True).alias("_offered"))
    gate = (
        F.when(F.col("sale_status").isNull(), "SALE_NOT_FOUND")
        .when(F.col("sale_status") != "ACTIVE", "SALE_NOT_ACTIVE")
        .when(F.col("_offered").isNull(), "PRODUCT_NOT_IN_SALE")
    )
    return known.join(offered, PRODUCT, "left").withColumn("gate", gate).drop("_offered")


def admit_requests(
    requests: DataFrame, totals: DataFrame, key: Sequence[str] = PRODUCT, blocks: int | None = None
) -> DataFrame:
    """First come, first served, one live purchase per user and product, no releases.

    Requests have key, user_id, ts and request_id. Only a user's first request
    competes: it gets in while its rank among first requests is within the stock.
    A later one is a repeat purchase when the first got in, else there is no stock.
    """
    firsts = requests.groupBy(*key, "user_id").agg(F.min(F.struct("ts", "request_id")).alias("_first")).select(
        *key, "user_id", F.col("_first.ts").alias("_ts"), F.col("_first.request_id").alias("_first_id")
    )
    ranked = row_numbers(firsts, list(key), ["_ts", "_first_id"], "_rank", blocks).join(
        totals.select(*key, "total_qty"), list(key), "left"
    )
    first = F.col("request_id") == F.col("_first_id")
    inside = F.col("_rank") <= F.col("total_qty")
    return (
        requests.join(ranked.drop("_ts"), [*key, "user_id"])
        .withColumn(
            "outcome",
            F.when(F.col("total_qty").isNull(), "SALE_NOT_FOUND")
            .when(~inside, "OUT_OF_STOCK")
            .when(first, "ADMITTED")
            .otherwise("ALREADY_PURCHASED"),
        )
        .withColumn("items_remaining", F.when(first & inside, F.col("total_qty") - F.col("_rank")).cast("int"))
        .drop("_rank", "_first_id", "total_qty")
    )


def _purchase_step(state: list, row: tuple) -> tuple:
    """State: [level, {live user: units held}]."""
    total, kind, user, units = row
    if not state:
        state.extend([total, {}])
    level, live = state
    who = str(user)
    if kind == "release":
        if who in live:
            state[0] = level + live.pop(who)
            return "RELEASED", state[0]
        return "IGNORED", level
    if who in live:
        return "ALREADY_PURCHASED", level
    if level is None:
        return "SALE_NOT_FOUND", None
    if level < units:
        return "OUT_OF_STOCK", level
    live[who] = units
    state[0] = level - units
    return "ADMITTED", state[0]


def admit_with_releases(
    log: DataFrame,
    totals: DataFrame,
    key: Sequence[str] = PRODUCT,
    units: str = "per_order",
    blocks: int | None = None,
) -> DataFrame:
    """Admission where a declined payment gives the unit back and lets the user buy again.

    `log` has key, ts, id, kind ('request' or 'release') and user_id. Whether a
    repeat counts depends on earlier outcomes, so this is a keyed replay; a key's
    state is its level and its live buyers, at most its stock. A purchase takes
    one unit, or its `quantity` with units="quantity".
    """
    taken = F.lit(1) if units == "per_order" else F.col("quantity").cast("int")
    opened = log.join(totals.select(*key, "total_qty"), list(key), "left").withColumn("units", taken)
    return replay(
        opened,
        list(key),
        ["ts", "id"],
        ["total_qty", "kind", "user_id", "units"],
        row_by_row(_purchase_step),
        "outcome STRING, items_remaining INT",
        blocks,
    ).drop("total_qty", "units")


def materialize_orders(admitted: DataFrame, sale_products: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """Orders, items, ORDER_CREATED events and reserved stock of admitted requests.

    All four come from one pinned frame with ids derived from the request, so
    they agree, and writing them again yields the same rows.
    """
    offered = sale_products.select(
        F.col("id").alias("sale_product_id"), "sale_id", "product_id", F.col("sale_price").alias("unit_price")
    )
    named = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    lines = store(
        admitted.join(offered, PRODUCT)
        .join(named, "product_id")
        .withColumn("order_id", F.md5(F.concat(F.lit("order:"), F.col("request_id").cast("string"))))
        .withColumn("total_amount", to_money(F.col("unit_price") * F.col("quantity")))
    )
    orders = lines.select(
        F.col("order_id").alias("id"),
        "user_id",
        "sale_id",
        "idempotency_key",
        F.lit("PENDING").alias("status"),
        "total_amount",
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )
    items = lines.select(
        F.concat(F.lit("item:"), "order_id").alias("id"),
        "order_id",
        "product_id",
        F.col("quantity").cast("int").alias("quantity"),
        "unit_price",
    )
    events = lines.select(
        F.lit("ORDER_CREATED").alias("event_type"),
        order_created_payload().alias("payload"),
        F.col("order_id").alias("event_key"),
        F.col("ts").alias("created_at"),
    )
    added = lines.groupBy(F.col("sale_product_id").alias("id")).agg(F.sum("quantity").alias("_added"))
    reserved = (
        sale_products.join(added, "id", "left")
        .withColumn(
            "reserved_qty", (F.col("reserved_qty") + F.coalesce("_added", F.lit(0))).cast("int")
        )
        .drop("_added")
    )
    return {"orders": orders, "order_items": items, "outbox": events, "sale_products": reserved}


def admission_funnel(
    requests: DataFrame,
    sales: DataFrame,
    sale_products: DataFrame,
    prior: DataFrame | None = None,
    presets: dict | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Every request with the one outcome of the whole admission chain.

    Requests: request_id, user_id, ts, ms, sale_id, product_id, sale_product_id,
    quantity, idempotency_key. `prior` lists (user_id, sale_id, product_id)
    already held. Order of checks: limiters, request rules, idempotency, gates,
    prior purchase, stock.

    A request is DUPLICATE when an earlier one with its key was admitted. A key
    reused for another user or product than its first request is reported as
    KEY_CONFLICT and does not compete.
    """
    other = [c for c in requests.columns if c not in ("request_id", "user_id", "ms")]
    log = limit_chain(requests, "ms", "request_id", presets=presets, blocks=blocks, carry=other).withColumnRenamed(
        "id", "request_id"
    )
    out = ["request_id", "user_id", "ts", *PRODUCT, "quantity", "idempotency_key", "outcome", "items_remaining"]
    none = F.lit(None).cast("int").alias("items_remaining")
    checked = dq_order_requests(log).withColumn(
        "outcome",
        F.coalesce(F.concat(F.lit("RATE_LIMITED_"), F.upper("stopped_by")), F.col("error_code")),
    )
    # Read three times below; unstored, the last limiter would be folded each time.
    checked = store(checked, "funnel-checked")
    turned_away = checked.filter("outcome IS NOT NULL").withColumn("items_remaining", none)

    passed = checked.filter("outcome IS NULL").withColumn(
        "_key", F.coalesce("idempotency_key", F.concat(F.lit("request:"), F.col("request_id").cast("string")))
    )
    target = F.struct("user_id", *PRODUCT)
    owners = passed.groupBy("_key").agg(F.min_by(target, F.struct("ts", "request_id")).alias("_owner"))
    keyed = passed.join(owners, "_key").withColumn("_conflict", ~target.eqNullSafe(F.col("_owner"))).drop("_owner")
    gated = gate_sale_and_product(keyed, sales, sale_products)
    if prior is not None:
        held = prior.select("user_id", *PRODUCT).distinct().withColumn("_held", F.lit(True))
        gated = gated.join(held, ["user_id", *PRODUCT], "left")
    else:
        gated = gated.withColumn("_held", F.lit(None).cast("boolean"))
    stop = (
        F.when(F.col("_conflict"), "KEY_CONFLICT")
        .when(F.col("gate").isNotNull(), F.col("gate"))
        .when(F.col("_held"), "ALREADY_PURCHASED")
    )
    # Read by the stock stage, by the key owners and for the stopped requests.
    gated = store(gated.withColumn("outcome", stop).select(*out[:-1], "_key"))
    competing = admit_requests(gated.filter("outcome IS NULL").drop("outcome"), sale_products, blocks=blocks)
    settled = gated.filter("outcome IS NOT NULL").withColumn("items_remaining", none).unionByName(competing)
    owner_of_key = competing.filter("outcome = 'ADMITTED'").select(
        "_key", F.struct("ts", "request_id").alias("_at")
    )
    repeat = F.coalesce(F.col("_at") < F.struct("ts", "request_id"), F.lit(False))
    decided = settled.join(owner_of_key, "_key", "left").withColumn(
        "outcome", F.when(repeat, "DUPLICATE").otherwise(F.col("outcome"))
    )
    return turned_away.select(*out).unionByName(decided.select(*out))


def funnel_counts(funnel: DataFrame) -> DataFrame:
    return funnel.groupBy("sale_id", "outcome").agg(F.count("*").alias("n"))
