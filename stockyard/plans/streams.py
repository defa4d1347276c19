"""Queries: the streaming operators, run over the tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockyard.plans import lifecycle as P
from stockyard.plans import processing as B
from stockyard.plans import reporting as R
from stockyard.plans.registry import query
from stockyard.schemas import struct
from stockyard.session import run_folder
from stockyard.sources.events import decode_events, event_stream
from stockyard.sources.fixtures import SALES_AS_OF, Fixtures, ts
from stockyard.streaming import streams as X


class StreamFixtures(Fixtures):
    """The fixture views with one raw table read as a stream."""

    def __init__(self, v: Fixtures, table: str):
        super().__init__(v.spark, v.folder)
        self.table = table

    def raw(self, name):
        if name != self.table:
            return super().raw(name)
        schema = super().raw(name).schema
        # A pattern, since only that may name a file as well as a folder of parts.
        return event_stream(self.spark, f"{self.folder}/{name}.parque[t]", schema)


def _streamed(v: Fixtures, table: str) -> StreamFixtures:
    return StreamFixtures(v, table)


@query(
    "src_event_stream",
    "SELECT id, event_type, CAST(json_extract_string(payload, '$.k') AS INTEGER) AS k, created_at FROM d_outbox",
)
def src_event_stream(v):
    log = decode_events(_streamed(v, "events").outbox, struct("k INT"))
    rows = X.run_to_files(log, run_folder(v.spark, "event-stream"))
    return rows.select("id", "event_type", F.col("body.k").alias("k"), "created_at")


@query("stock_level_stream", B._LEDGER, B._NO_COUNTER)
def stock_level_stream(v):
    totals = (
        v.stock_events.select("sale_id", "product_id")
        .distinct()
        .filter("product_id % 7 != 0")
        .withColumn("total_qty", (1 + F.col("product_id") % 3).cast("int"))
    )
    levels = X.stock_level_stream(_streamed(v, "events").stock_events, totals)
    return X.run_to_files(levels, run_folder(v.spark, "stock-level"))


@query("limit_stream", B._LIMITED, B.limiter_sql("lim", B._BY_USER, "3", f"{B.DAY}"))
def limit_stream(v):
    calls = _streamed(v, "events").raw("events").select(
        F.col("user_id").cast("string").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"),
    )
    verdicts = X.run_to_files(X.limit_stream(calls, 3, B.DAY), run_folder(v.spark, "limit"))
    return verdicts.drop("late")


@query("dedupe_stream", "SELECT DISTINCT idempotency_key FROM d_orders")
def dedupe_stream(v):
    log = _streamed(v, "orders").orders.select(
        "idempotency_key", F.col("created_at").cast("timestamp").alias("ts")
    )
    return X.run_to_files(X.dedupe_stream(log), run_folder(v.spark, "dedupe")).select("idempotency_key")


_PAID_AT = "created_at + INTERVAL 1 MINUTE * CAST(id % 30 AS INTEGER)"
_ALERTS = """SELECT key, epoch_us(opened) // 1000 AS opened_ms, epoch_us(opened) // 1000 + {age} * 60000 AS due_ms
    FROM x_spans WHERE CASE WHEN closed IS NOT NULL THEN closed > opened + INTERVAL {age} MINUTE
    ELSE opened + INTERVAL {age} MINUTE < (SELECT greatest(max(opened), max(closed)) FROM x_spans) END"""


def _changes(spans):
    """Open and close rows of a stream of (key, opened, closed) spans."""

    def change(at, kind):
        return F.struct(F.col("key"), F.col(at).cast("timestamp").alias("ts"), F.lit(kind).alias("kind"))

    rows = spans.select(F.explode(F.array(change("opened", "open"), change("closed", "close"))).alias("c"))
    return rows.select("c.*").filter("ts IS NOT NULL")


@query(
    "stuck_order_stream",
    _ALERTS.format(age=15),
    {
        "x_spans": f"""SELECT id AS key, created_at AS opened,
                       CASE WHEN status <> 'PENDING' THEN {_PAID_AT} END AS closed FROM d_orders"""
    },
)
def stuck_order_stream(v):
    spans = _streamed(v, "orders").orders.select(
        F.col("id").alias("key"),
        F.col("created_at").alias("opened"),
        F.when(
            F.col("status") != "PENDING", F.expr("created_at + make_dt_interval(0, 0, cast(id % 30 AS INT))")
        ).alias("closed"),
    )
    alerts = X.stuck_order_stream(_changes(spans), "0 seconds")  # a whole log in order: nothing comes late
    return X.run_to_files(alerts, run_folder(v.spark, "stuck"))


@query(
    "unsettled_stream",
    """SELECT key, epoch_us(opened) // 1000 AS opened_ms, epoch_us(opened) // 1000 + 15 * 60000 AS due_ms FROM x_spans
       WHERE coalesce(closed > opened + INTERVAL 15 MINUTE, true)
         AND opened + INTERVAL 15 MINUTE < (SELECT least(max(opened), max(closed)) FROM x_spans)""",
    {
        "x_spans": f"""SELECT id AS key, created_at AS opened,
                       CASE WHEN status <> 'PENDING' THEN {_PAID_AT} END AS closed FROM d_orders"""
    },
)
def unsettled_stream(v):
    placed = _streamed(v, "orders").orders.select(F.col("id").alias("key"), F.col("created_at").cast("timestamp").alias("opened"))
    paid_at = F.expr("created_at + make_dt_interval(0, 0, cast(id % 30 AS INT))").cast("timestamp").alias("closed")
    settled = _streamed(v, "orders").orders.filter("status <> 'PENDING'").select(F.col("id").alias("key"), paid_at)
    alerts = X.unsettled_stream(placed, settled, delay="0 seconds")
    return X.run_to_files(alerts, run_folder(v.spark, "unsettled"))


@query(
    "stale_outbox_stream",
    _ALERTS.format(age=10),
    {
        "x_spans": f"""SELECT id AS key, created_at AS opened, CASE WHEN published THEN {_PAID_AT} END AS closed
                       FROM (SELECT * REPLACE (date_trunc('second', created_at) AS created_at) FROM d_outbox)"""
    },
)
def stale_outbox_stream(v):
    log = _streamed(v, "events").outbox.withColumn("created_at", F.date_trunc("second", "created_at"))
    spans = log.select(
        F.col("id").alias("key"),
        F.col("created_at").alias("opened"),
        F.when(F.col("published"), F.expr("created_at + make_dt_interval(0, 0, cast(id % 30 AS INT))")).alias("closed"),
    )
    alerts = X.stale_outbox_stream(_changes(spans), "0 seconds")
    return X.run_to_files(alerts, run_folder(v.spark, "stale"))


@query(
    "route_stream",
    f"""SELECT id, CASE event_type WHEN 'ORDER_CREATED' THEN 'order.created' WHEN 'PAYMENT_SUCCESS'
              THEN 'payment.success' ELSE 'payment.failed' END AS queue FROM d_outbox
        WHERE NOT published AND {P._KNOWN}""",
)
def route_stream(v):
    return X.route_stream(_streamed(v, "events").outbox, run_folder(v.spark, "route")).select("id", "queue")


@query(
    "payment_stream",
    "SELECT order_id, CASE WHEN success THEN 'CONFIRMED' ELSE 'FAILED' END AS status FROM x_paid",
    P._PAY,
)
def payment_stream(v):
    """Messages stream from the orders table; each order is delivered twice."""
    facts = P.payment_messages(v)
    arriving = _streamed(v, "orders").orders.select(
        F.col("id").alias("order_id"), F.col("created_at").cast("timestamp").alias("ts")
    )
    twice = arriving.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    messages = twice.join(facts, "order_id")
    return X.payment_stream(
        messages,
        v.orders,
        v.sale_products,
        v.live_counters,
        P.payment_outcomes(v),
        run_folder(v.spark, "payment"),
        ts(SALES_AS_OF),
    ).select("order_id", "status")


@query(
    "sale_status_stream",
    """SELECT id AS sale_id, CASE WHEN status = 'ACTIVE' THEN 'ENDED' ELSE 'ACTIVE' END AS status FROM d_sales
       WHERE status = 'ACTIVE' AND end_time <= (SELECT max(o_orderdate) FROM orders)
          OR status = 'SCHEDULED' AND start_time <= (SELECT max(o_orderdate) FROM orders)""",
)
def sale_status_stream(v):
    """The order dates drive the clock."""
    ticks = _streamed(v, "orders").orders.select(F.col("created_at").alias("ts"))
    state = {
        "sales": v.sales, "sale_products": v.sale_products, "inventory": v.inventory, "counters": v.live_counters
    }
    return X.sale_status_stream(ticks, state, run_folder(v.spark, "sale-status"))


@query("sale_monitor_stream", R._MONITOR)
def sale_monitor_stream(v):
    """Every order is placed as PENDING and then gets its status, which is told twice."""
    lines = v.order_items.groupBy(F.col("order_id").alias("id")).agg(F.collect_list("product_id").alias("product_ids"))
    placed = _streamed(v, "orders").orders.join(lines, "id")

    def change(seq, status, products):
        return F.struct(F.lit(seq).cast("bigint").alias("seq"), status.alias("status"), products.alias("product_ids"))

    later = change(1, F.col("status"), F.lit(None).cast("array<bigint>"))
    first = change(0, F.lit("PENDING"), F.col("product_ids"))
    changes = placed.select(
        F.col("id").alias("order_id"), "sale_id", F.col("total_amount").alias("amount"), F.explode(F.array(later, first, later)).alias("c")
    )
    changes = changes.select("order_id", "c.seq", "sale_id", "c.product_ids", "c.status", "amount")
    return X.sale_monitor_stream(changes, v.sale_products, v.products, run_folder(v.spark, "sale-monitor"))
