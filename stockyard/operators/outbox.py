"""Event bodies, the event log and its relay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.operators.sizing import broadcast_when, is_small
from stockyard.schemas import EVENT_BODIES, EVENT_QUEUES, STUCK_PRODUCT_NAME, STUCK_REASON
from stockyard.session import store

BATCH = 50


def _json(**fields: Column) -> Column:
    """A JSON object that keeps NULL keys."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def order_created_payload() -> Column:
    return _json(
        orderId=F.col("order_id"),
        userId=F.col("user_id"),
        saleId=F.col("sale_id"),
        saleProductId=F.col("sale_product_id"),
        productId=F.col("product_id"),
        productName=F.col("product_name"),
        quantity=F.col("quantity"),
        unitPrice=F.col("unit_price"),
        totalAmount=F.col("total_amount").cast("string"),
        idempotencyKey=F.col("idempotency_key"),
    )


def payment_success_payload() -> Column:
    return _json(
        orderId=F.col("order_id"),
        userId=F.col("user_id"),
        transactionId=F.col("transaction_id"),
        amount=F.col("total_amount").cast("string"),
        productName=F.col("product_name"),
    )


def payment_failed_payload(reason: Column) -> Column:
    return _json(
        orderId=F.col("order_id"),
        userId=F.col("user_id"),
        reason=reason,
        productName=F.col("product_name"),
        amount=F.col("total_amount").cast("string"),
    )


def stuck_order_payload() -> Column:
    return _json(
        orderId=F.col("order_id"),
        userId=F.col("user_id"),
        reason=F.lit(STUCK_REASON),
        amount=F.col("total_amount").cast("string"),
        productName=F.lit(STUCK_PRODUCT_NAME),
    )


def append_events(outbox: DataFrame, events: DataFrame, batch_id: str, created_at: Column) -> DataFrame:
    """The log with a batch of events (event_type, payload, event_key) added, unpublished.

    Ids come from the batch, type and event key, so the same batch makes the same
    ids whenever it is tried again; events already in the log keep their first
    time and are not added. Of the log only the ids are compared: a short batch
    goes to them as a broadcast, a long one is shuffled.
    """
    fresh = events.select(
        F.md5(F.concat_ws(":", F.lit(batch_id), "event_type", F.col("event_key").cast("string"))).alias("id"),
        "event_type",
        "payload",
        F.lit(False).alias("published"),
        created_at.alias("created_at"),
    )
    fresh = store(fresh.dropDuplicates(["id"]), "events")
    log = outbox.withColumn("id", F.col("id").cast("string"))
    there = log.select("id").join(broadcast_when(is_small(fresh), fresh.select("id")), "id", "left_semi")
    return log.unionByName(fresh.join(there, "id", "left_anti"))


def routed(outbox: DataFrame) -> DataFrame:
    """Add the queue of each event type, NULL for types without one."""
    queue = F.create_map(*[F.lit(x) for pair in EVENT_QUEUES.items() for x in pair])
    return outbox.withColumn("queue", F.try_element_at(queue, F.col("event_type")))


def outbox_batch(outbox: DataFrame, batch: int = BATCH) -> DataFrame:
    """The oldest unpublished events."""
    return outbox.filter("NOT published").orderBy("created_at", "id").limit(batch)


def outbox_relay(outbox: DataFrame, batch: int = BATCH) -> DataFrame:
    """One poll: events of the batch with a queue become published, others keep their place."""
    sent = routed(outbox_batch(outbox, batch)).filter("queue IS NOT NULL").select("id", F.lit(True).alias("_sent"))
    return (
        outbox.join(F.broadcast(sent), "id", "left")
        .withColumn("published", F.col("published") | F.coalesce("_sent", F.lit(False)))
        .drop("_sent")
    )


def outbox_drained(outbox: DataFrame, batch: int = BATCH) -> DataFrame:
    """The log after polling until nothing moves: adds queue and state.

    Unroutable events stay in front. Once `batch` of them lead the line, nothing
    behind the last of these is ever polled; that event is a top-k of one row.
    """
    unpublished = routed(outbox).filter("NOT published")
    wall = (
        unpublished.filter("queue IS NULL")
        .orderBy("created_at", "id")
        .offset(batch - 1)
        .limit(1)
        .select(F.struct("created_at", "id").alias("_wall"))
    )
    behind = F.coalesce(F.struct("created_at", "id") > wall.scalar(), F.lit(False))
    state = (
        F.when(F.col("published"), "ALREADY_PUBLISHED")
        .when(F.col("queue").isNull(), "UNROUTABLE")
        .when(behind, "BLOCKED")
        .otherwise("RELAYED")
    )
    return routed(outbox).withColumn("state", state).withColumn(
        "published", F.col("published") | (F.col("state") == "RELAYED")
    )


def write_queues(outbox: DataFrame, path: str, mode: str = "append") -> None:
    """Write routable events to one folder per queue."""
    routed(outbox).filter("queue IS NOT NULL").write.mode(mode).partitionBy("queue").parquet(path)


def notification_rows(events: DataFrame) -> DataFrame:
    """Messages for PAYMENT_SUCCESS and PAYMENT_FAILED events (event_type, payload)."""
    kinds = {"PAYMENT_SUCCESS": "ORDER_CONFIRMATION", "PAYMENT_FAILED": "PAYMENT_FAILURE"}
    ours = events.filter(F.col("event_type").isin(*kinds))
    success = F.from_json("payload", EVENT_BODIES["PAYMENT_SUCCESS"])
    failed = F.from_json("payload", EVENT_BODIES["PAYMENT_FAILED"])
    ok = F.col("event_type") == "PAYMENT_SUCCESS"
    return ours.withColumn("_ok", success).withColumn("_bad", failed).select(
        F.when(ok, kinds["PAYMENT_SUCCESS"]).otherwise(kinds["PAYMENT_FAILED"]).alias("kind"),
        F.coalesce("_ok.orderId", "_bad.orderId").alias("order_id"),
        F.coalesce("_ok.productName", "_bad.productName").alias("product_name"),
        F.coalesce("_ok.amount", "_bad.amount").alias("amount"),
        F.when(ok, F.col("_ok.transactionId")).alias("transaction_id"),
        F.when(~ok, F.col("_bad.reason")).alias("reason"),
    )
