"""Queries: state transitions, payments, reconciliation and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockyard.operators import outbox as O
from stockyard.operators import reconcile as C
from stockyard.operators import transitions as T
from stockyard.plans.registry import query
from stockyard.plans.sqlviews import EVENTS_AS_OF as SQL_EVENTS_AS_OF
from stockyard.plans.sqlviews import SALES_AS_OF as SQL_AS_OF
from stockyard.schemas import STUCK_PRODUCT_NAME, STUCK_REASON
from stockyard.session import run_folder
from stockyard.sources.fixtures import EVENTS_AS_OF, LINE_IDS, SALES_AS_OF, ts

TICK = "2001-08-01 00:00:00"
SQL_TICK = f"TIMESTAMP '{TICK}'"


def _at(text: str = SALES_AS_OF):
    return ts(text)


# sale lifecycle

_START = f"status = 'SCHEDULED' AND start_time <= {SQL_TICK} AND id IN (SELECT sale_id FROM d_sale_products)"
_END = f"status = 'ACTIVE' AND end_time <= {SQL_TICK}"
_DUE = {
    "x_starting": f"SELECT id FROM d_sales WHERE {_START}",
    "x_ending": f"SELECT id FROM d_sales WHERE {_END}",
    "x_left": """SELECT sp.id, c.live_qty FROM d_sale_products sp JOIN d_live_counters c ON c.sale_product_id = sp.id
                 WHERE sp.sale_id IN (SELECT id FROM x_ending)""",
    "x_opened": """SELECT id AS sale_product_id, total_qty AS live_qty FROM d_sale_products
                   WHERE sale_id IN (SELECT id FROM x_starting)""",
}


def _sales_sql(*cases: str) -> str:
    return f"SELECT id, name, CASE {' '.join(cases)} ELSE status END AS status FROM d_sales"


_STARTED = "WHEN id IN (SELECT id FROM x_starting) THEN 'ACTIVE'"
_ENDED = "WHEN id IN (SELECT id FROM x_ending) THEN 'ENDED'"
_KEEP_OPENED = """SELECT * FROM d_live_counters WHERE sale_product_id NOT IN (SELECT sale_product_id FROM x_opened)"""


def _activated(v):
    return T.activate_sales(v.sales, v.sale_products, v.live_counters, _at(TICK))


def _settled(v):
    return T.settle_ended_sales(v.sales, v.sale_products, v.inventory, v.live_counters, _at(TICK))


def _advanced(v):
    return T.advance_sales(v.sales, v.sale_products, v.inventory, v.live_counters, _at(TICK))


def _heads(sales):
    return sales.select("id", "name", "status")


@query("activate_sales", _sales_sql(_STARTED), _DUE)
def activate_sales(v):
    return _heads(_activated(v)["sales"])


@query("activate_sales_counters", f"{_KEEP_OPENED} UNION ALL SELECT * FROM x_opened", _DUE)
def activate_sales_counters(v):
    return _activated(v)["counters"]


@query(
    "activate_sales_cache",
    f"""SELECT id, name, 'ACTIVE' AS status, strftime(end_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS end_time,
              (epoch_us(end_time) - epoch_us({SQL_TICK})) // 1000000 + 3600 AS ttl_s
        FROM d_sales WHERE id IN (SELECT id FROM x_starting)""",
    _DUE,
)
def activate_sales_cache(v):
    return _activated(v)["cache"]


@query(
    "settle_ended_sales",
    """SELECT sp.id, sp.total_qty, CASE WHEN l.id IS NOT NULL THEN greatest(0, sp.total_qty - l.live_qty)
              ELSE sp.reserved_qty END AS reserved_qty
       FROM d_sale_products sp LEFT JOIN x_left l ON l.id = sp.id""",
    _DUE,
)
def settle_ended_sales(v):
    return _settled(v)["sale_products"].select("id", "total_qty", "reserved_qty")


@query(
    "settle_ended_sales_inventory",
    f"""SELECT i.sale_product_id, CASE WHEN l.id IS NOT NULL THEN greatest(0, l.live_qty) ELSE i.available_qty END
                AS available_qty,
              CASE WHEN l.id IS NOT NULL THEN {SQL_TICK} ELSE i.last_synced_at END AS last_synced_at
       FROM d_inventory i LEFT JOIN x_left l ON l.id = i.sale_product_id""",
    _DUE,
)
def settle_ended_sales_inventory(v):
    return _settled(v)["inventory"].drop("id")


@query("advance_sales", _sales_sql(_STARTED, _ENDED), _DUE)
def advance_sales(v):
    return _heads(_advanced(v)["sales"])


@query(
    "advance_sales_counters",
    f"""SELECT * FROM ({_KEEP_OPENED}) WHERE sale_product_id NOT IN (SELECT id FROM x_left)
        UNION ALL SELECT * FROM x_opened""",
    _DUE,
)
def advance_sales_counters(v):
    return _advanced(v)["counters"]


@query(
    "feed_sale_status",
    f"""SELECT n.id AS sale_id, n.status FROM ({_sales_sql(_STARTED, _ENDED)}) n JOIN d_sales o
        ON o.id = n.id AND o.status <> n.status""",
    _DUE,
)
def feed_sale_status(v):
    return T.feed_sale_status(v.sales, _advanced(v)["sales"])


@query(
    "cancel_sales",
    _sales_sql("WHEN status = 'SCHEDULED' AND id % 2 = 0 OR status = 'SCHEDULED' AND id % 2 = 1 AND id > 200107 "
               "THEN 'ENDED'"),
)
def cancel_sales(v):
    asked = v.sales.filter("id % 2 = 0 OR id < 200101 OR id > 200107").select(F.col("id").alias("sale_id"))
    return _heads(T.cancel_sales(v.sales, asked))


# catalogue changes

_CHANGES = """SELECT sale_id, product_id, sale_price, total_qty FROM (
    SELECT *, row_number() OVER (PARTITION BY sale_id, product_id ORDER BY seq DESC) AS back FROM (
        SELECT sale_id, product_id, CAST(sale_price + 1 AS DECIMAL(10,2)) AS sale_price,
               CAST(total_qty * 2 AS INTEGER) AS total_qty, 1 AS seq FROM d_sale_products WHERE product_id % 3 = 0
        UNION ALL SELECT sale_id, product_id, CAST(sale_price + 2 AS DECIMAL(10,2)), CAST(total_qty + 7 AS INTEGER), 2
        FROM d_sale_products WHERE product_id % 9 = 0
        UNION ALL SELECT sale_id + 1000000, product_id, sale_price, CAST(total_qty + s AS INTEGER), 2 - s
        FROM d_sale_products, (SELECT 0 AS s UNION ALL SELECT 1) WHERE product_id % 50 = 0)) WHERE back = 1"""
_MERGED = """SELECT coalesce(o.id, n.sale_id * 100000000000 + n.product_id) AS id, sale_id, product_id,
    coalesce(n.sale_price, o.sale_price) AS sale_price, coalesce(n.total_qty, o.total_qty) AS total_qty,
    coalesce(o.reserved_qty, 0) AS reserved_qty, n.total_qty AS changed
    FROM d_sale_products o FULL JOIN x_changes n USING (sale_id, product_id)"""
_CHANGE_VIEWS = {"x_changes": _CHANGES, "x_merged": _MERGED}


def _new_id():
    return F.col("sale_id") * LINE_IDS + F.col("product_id")


def _changes(v):
    raised = v.sale_products.filter("product_id % 3 = 0").select(
        "sale_id",
        "product_id",
        (F.col("sale_price") + 1).cast("decimal(10,2)").alias("sale_price"),
        (F.col("total_qty") * 2).alias("total_qty"),
        F.lit(1).alias("seq"),
    )
    again = v.sale_products.filter("product_id % 9 = 0").select(
        "sale_id",
        "product_id",
        (F.col("sale_price") + 2).cast("decimal(10,2)").alias("sale_price"),
        (F.col("total_qty") + 7).alias("total_qty"),
        F.lit(2).alias("seq"),
    )
    added = v.sale_products.filter("product_id % 50 = 0").select(
        (F.col("sale_id") + 1_000_000).alias("sale_id"), "product_id", "sale_price", "total_qty"
    )
    added = added.withColumn("_s", F.explode(F.array(F.lit(0), F.lit(1))))
    twice = added.withColumn("total_qty", F.col("total_qty") + F.col("_s")).withColumn("seq", 2 - F.col("_s"))
    return raised.unionByName(again).unionByName(twice.drop("_s"))


@query("sink_upsert", "SELECT id, sale_id, product_id, sale_price, total_qty, reserved_qty FROM x_merged", _CHANGE_VIEWS)
def sink_upsert(v):
    return T.upsert(
        v.sale_products,
        _changes(v),
        ["sale_id", "product_id"],
        ["sale_price", "total_qty"],
        {"id": _new_id(), "reserved_qty": F.lit(0)},
        ["seq"],
    )


@query(
    "upsert_sale_products",
    f"""SELECT m.id AS sale_product_id, m.sale_price, m.total_qty, m.reserved_qty,
              coalesce(m.changed, i.available_qty) AS available_qty,
              CASE WHEN m.changed IS NOT NULL THEN {SQL_AS_OF} ELSE i.last_synced_at END AS last_synced_at
       FROM x_merged m LEFT JOIN d_inventory i ON i.sale_product_id = m.id""",
    _CHANGE_VIEWS,
)
def upsert_sale_products(v):
    out = T.upsert_sale_products(v.sale_products, v.inventory, _changes(v), _at(), _new_id(), ["seq"])
    prices = out["sale_products"].select(
        F.col("id").alias("sale_product_id"), "sale_price", "total_qty", "reserved_qty"
    )
    return prices.join(out["inventory"].drop("id"), "sale_product_id")


_REMOVALS = """SELECT CASE WHEN product_id % 7 = 0 THEN sale_id + 1 ELSE sale_id END AS sale_id, id AS sale_product_id
               FROM d_sale_products WHERE product_id % 2 = 0"""


@query(
    "remove_sale_products",
    """SELECT sp.id, sp.sale_id, i.available_qty FROM d_sale_products sp JOIN d_inventory i ON i.sale_product_id = sp.id
       WHERE NOT EXISTS (SELECT 1 FROM x_removals r JOIN d_sales s ON s.id = r.sale_id AND s.status = 'SCHEDULED'
                         WHERE r.sale_product_id = sp.id AND r.sale_id = sp.sale_id)""",
    {"x_removals": _REMOVALS},
)
def remove_sale_products(v):
    removals = v.sale_products.filter("product_id % 2 = 0").select(
        F.when(F.col("product_id") % 7 == 0, F.col("sale_id") + 1).otherwise(F.col("sale_id")).alias("sale_id"),
        F.col("id").alias("sale_product_id"),
    )
    out = T.remove_sale_products(v.sales, v.sale_products, v.inventory, removals)
    levels = out["inventory"].select(F.col("sale_product_id").alias("id"), "available_qty")
    return out["sale_products"].select("id", "sale_id").join(levels, "id", "full")


_PATCHES = """SELECT 1 AS seq, CASE WHEN p_partkey % 17 = 0 THEN -1 - p_partkey ELSE p_partkey END AS id,
    p_partkey % 2 = 0 AS has_name, '  New ' || p_name || ' ' AS name,
    p_partkey % 3 = 0 AS has_description, ' ' AS description,
    p_partkey % 5 = 0 AS has_base_price, CASE WHEN p_partkey % 25 = 0 THEN 'free' ELSE '12.50' END AS base_price,
    p_partkey % 7 = 0 AS has_is_active, CASE WHEN p_partkey % 14 = 0 THEN 'true' ELSE 'yes' END AS is_active,
    p_partkey % 11 = 0 AS has_image_key, 'products/new.png' AS image_key FROM part
    UNION ALL SELECT 2, p_partkey, false, NULL, p_partkey % 8 = 0, 'later', p_partkey % 10 = 0,
    CASE WHEN p_partkey % 20 = 0 THEN '-1' ELSE '7.25' END, false, NULL, false, NULL FROM part WHERE p_partkey % 4 = 0"""
_PATCH_VIEWS = {
    "x_patches": _PATCHES,
    "x_bad": """SELECT p.*, CASE WHEN d.id IS NULL THEN 'PRODUCT_NOT_FOUND'
                    WHEN has_base_price AND p.base_price IN ('free', '-1') THEN 'INVALID_PRICE'
                    WHEN NOT (has_name OR has_description OR has_base_price OR has_is_active OR has_image_key)
                      THEN 'NO_FIELDS' END AS error_code
                FROM x_patches p LEFT JOIN d_products d ON d.id = p.id""",
}


def _patched(v):
    patches = v.spark.sql(_PATCHES.replace("FROM part", "FROM {part}"), part=v.raw("part"))
    return T.patch_products(v.products, patches, ["seq"])


@query(
    "patch_products",
    """SELECT d.id, CASE WHEN p.has_name THEN trim(p.name) ELSE d.name END AS name,
              CASE WHEN p.has_description THEN trim(p.description) ELSE d.description END AS description,
              CASE WHEN p.has_base_price THEN CAST(p.base_price AS DECIMAL(10,2)) ELSE d.base_price END AS base_price,
              CASE WHEN p.has_image_key THEN p.image_key ELSE d.image_key END AS image_key,
              CASE WHEN p.has_is_active THEN p.is_active = 'true' ELSE d.is_active END AS is_active
       FROM d_products d LEFT JOIN (
           SELECT id, bool_or(has_name) AS has_name, max_by(name, seq) FILTER (has_name) AS name,
                  bool_or(has_description) AS has_description, max_by(description, seq) FILTER (has_description) AS description,
                  bool_or(has_base_price) AS has_base_price, max_by(base_price, seq) FILTER (has_base_price) AS base_price,
                  bool_or(has_is_active) AS has_is_active, max_by(is_active, seq) FILTER (has_is_active) AS is_active,
                  bool_or(has_image_key) AS has_image_key, max_by(image_key, seq) FILTER (has_image_key) AS image_key
           FROM x_bad WHERE error_code IS NULL GROUP BY id) p ON p.id = d.id""",
    _PATCH_VIEWS,
)
def patch_products(v):
    return _patched(v)["products"].drop("created_at")


@query("patch_products_rejected", "SELECT id, error_code FROM x_bad WHERE error_code IS NOT NULL", _PATCH_VIEWS)
def patch_products_rejected(v):
    return _patched(v)["rejected"]


@query(
    "deactivate_products",
    """SELECT id, is_active AND id % 4 <> 0 AS is_active,
              CASE WHEN id % 4 = 0 AND NOT is_active THEN 'NOT_FOUND_OR_INACTIVE' END AS error_code FROM d_products""",
)
def deactivate_products(v):
    out = T.deactivate_products(v.products, v.products.filter("id % 4 = 0").select("id"))
    return out["products"].select("id", "is_active").join(out["rejected"], "id", "left")


# payments

_MESSAGES = """SELECT l.order_id, o.user_id, sp.id AS sale_product_id, CAST(l.quantity AS BIGINT) AS quantity,
                      o.total_amount, p.name AS product_name
               FROM (SELECT order_id, product_id, sum(quantity) AS quantity,
                            row_number() OVER (PARTITION BY order_id ORDER BY product_id) AS rn
                     FROM d_order_items GROUP BY 1, 2) l
               JOIN d_orders o ON o.id = l.order_id JOIN d_products p ON p.id = l.product_id
               JOIN d_sale_products sp ON sp.sale_id = o.sale_id AND sp.product_id = l.product_id WHERE l.rn = 1"""
_PAID = """SELECT m.*, m.order_id % 10 <> 0 AS success, 'txn_' || m.order_id AS transaction_id
           FROM x_messages m JOIN d_orders o ON o.id = m.order_id AND o.status = 'PENDING'"""
_PAY = {"x_messages": _MESSAGES, "x_paid": _PAID}
# Fixed value: the reason of a declined payment.
_DECLINED = "Payment declined by gateway."


def payment_messages(v, again=False):
    """One ORDER_CREATED message per order, for the product with the lowest id; some twice if `again`."""
    first = (
        v.order_items.groupBy("order_id", "product_id")
        .agg(F.sum("quantity").alias("quantity"))
        .groupBy("order_id")
        .agg(F.min_by(F.struct("product_id", "quantity"), "product_id").alias("_l"))
        .select("order_id", "_l.*")
    )
    heads = v.orders.select(F.col("id").alias("order_id"), "user_id", "sale_id", "total_amount")
    named = v.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    keys = v.sale_products.select(F.col("id").alias("sale_product_id"), "sale_id", "product_id")
    once = first.join(heads, "order_id").join(named, "product_id").join(keys, ["sale_id", "product_id"]).select(
        "order_id", "user_id", "sale_product_id", "quantity", "total_amount", "product_name"
    )
    copies = F.array_repeat(F.lit(1), F.when(F.col("order_id") % 4 == 0, 2).otherwise(1))
    return once.withColumn("_copy", F.explode(copies)).drop("_copy") if again else once


def payment_outcomes(v):
    """A first answer per order, contradicting repeats for some, and answers for unknown orders."""
    id_ = F.col("id")
    first = v.orders.select(
        id_.alias("order_id"),
        (id_ * 2).alias("delivery_id"),
        (id_ % 10 != 0).alias("success"),
        F.concat(F.lit("txn_"), id_.cast("string")).alias("transaction_id"),
        F.lit(_DECLINED).alias("reason"),
    )
    again = first.filter("order_id % 3 = 0").withColumn("delivery_id", F.col("delivery_id") + 1).withColumn(
        "success", ~F.col("success")
    )
    unknown = first.filter("order_id % 50 = 0").withColumn("order_id", -1 - F.col("order_id"))
    return first.unionByName(again).unionByName(unknown)


def _paid(v, **options):
    return T.apply_payment_outcomes(
        v.orders, v.sale_products, v.live_counters, payment_messages(v, True), payment_outcomes(v), _at(), **options
    )


@query(
    "apply_payment_outcomes",
    f"""SELECT o.id, CASE WHEN p.success THEN 'CONFIRMED' WHEN NOT p.success THEN 'FAILED' ELSE o.status END AS status,
              CASE WHEN p.order_id IS NOT NULL THEN {SQL_AS_OF} ELSE o.updated_at END AS updated_at
       FROM d_orders o LEFT JOIN x_paid p ON p.order_id = o.id""",
    _PAY,
)
def apply_payment_outcomes(v):
    return _paid(v)["orders"].select("id", "status", "updated_at")


@query(
    "apply_payment_outcomes_stock",
    """SELECT sp.id, CAST(CASE WHEN q IS NULL THEN reserved_qty ELSE greatest(0, reserved_qty - q) END AS INTEGER)
                AS reserved_qty, CAST(c.live_qty + coalesce(n, 0) AS INTEGER) AS live_qty
       FROM d_sale_products sp LEFT JOIN d_live_counters c ON c.sale_product_id = sp.id
       LEFT JOIN (SELECT sale_product_id, sum(quantity) AS q, count(*) AS n FROM x_paid WHERE NOT success GROUP BY 1) f
         ON f.sale_product_id = sp.id""",
    _PAY,
)
def apply_payment_outcomes_stock(v):
    out = _paid(v)
    levels = out["counters"].withColumnRenamed("sale_product_id", "id")
    return out["sale_products"].select("id", "reserved_qty").join(levels, "id", "left")


@query(
    "apply_payment_outcomes_created",
    """SELECT coalesce(c.sale_product_id, f.sale_product_id) AS sale_product_id,
              CAST(coalesce(c.live_qty, 0) + coalesce(f.q, 0) AS INTEGER) AS live_qty
       FROM d_live_counters c FULL JOIN
            (SELECT sale_product_id, sum(quantity) AS q FROM x_paid WHERE NOT success GROUP BY 1) f
         ON f.sale_product_id = c.sale_product_id""",
    _PAY,
)
def apply_payment_outcomes_created(v):
    return _paid(v, units="quantity", release_creates=True)["counters"]


_PAY_EVENTS = f"""SELECT CASE WHEN success THEN 'PAYMENT_SUCCESS' ELSE 'PAYMENT_FAILED' END AS event_type, order_id,
    CASE WHEN success THEN '{{"orderId":' || order_id || ',"userId":' || user_id || ',"transactionId":"'
        || transaction_id || '","amount":"' || total_amount || '","productName":"' || product_name || '"}}'
    ELSE '{{"orderId":' || order_id || ',"userId":' || user_id || ',"reason":"{_DECLINED}","productName":"'
        || product_name || '","amount":"' || total_amount || '"}}' END AS payload FROM x_paid"""
_PAY_LOG = {**_PAY, "x_pay_events": _PAY_EVENTS}


@query(
    "sink_outbox_append",
    f"""SELECT CAST(id AS VARCHAR) AS id, event_type, payload, published, created_at FROM d_outbox
        UNION ALL SELECT md5('run-1:' || event_type || ':' || order_id), event_type, payload, false, {SQL_AS_OF}
        FROM x_pay_events""",
    _PAY_LOG,
)
def sink_outbox_append(v):
    """The batch is tried again five minutes later."""
    events = _paid(v)["outbox"]
    log = O.append_events(v.outbox, events, "run-1", _at())
    return O.append_events(log, events, "run-1", _at() + F.expr("INTERVAL 5 MINUTES"))


@query(
    "notification_rows",
    f"""SELECT CASE WHEN success THEN 'ORDER_CONFIRMATION' ELSE 'PAYMENT_FAILURE' END AS kind,
              CAST(order_id AS VARCHAR) AS order_id, product_name, CAST(total_amount AS VARCHAR) AS amount,
              CASE WHEN success THEN transaction_id END AS transaction_id,
              CASE WHEN NOT success THEN '{_DECLINED}' END AS reason FROM x_paid""",
    _PAY,
)
def notification_rows(v):
    return O.notification_rows(_paid(v)["outbox"])


# event log


@query(
    "outbox_batch",
    "SELECT * FROM d_outbox WHERE NOT published ORDER BY created_at, id LIMIT 50",
)
def outbox_batch(v):
    return O.outbox_batch(v.outbox)


_KNOWN = "event_type IN ('ORDER_CREATED', 'PAYMENT_SUCCESS', 'PAYMENT_FAILED')"


@query(
    "outbox_relay",
    f"""SELECT id, event_type, published OR ({_KNOWN} AND id IN (SELECT id FROM d_outbox WHERE NOT published
              ORDER BY created_at, id LIMIT 50)) AS published FROM d_outbox""",
)
def outbox_relay(v):
    return O.outbox_relay(v.outbox).select("id", "event_type", "published")


@query(
    "outbox_drained",
    f"""SELECT id, event_type, published OR state = 'RELAYED' AS published, state
        FROM (SELECT *, CASE WHEN published THEN 'ALREADY_PUBLISHED' WHEN NOT known THEN 'UNROUTABLE'
                             WHEN ahead >= 50 THEN 'BLOCKED' ELSE 'RELAYED' END AS state
              FROM (SELECT *, {_KNOWN} AS known, count(*) FILTER (NOT published AND NOT {_KNOWN})
                      OVER (ORDER BY created_at, id) AS ahead FROM d_outbox))""",
)
def outbox_drained(v):
    return O.outbox_drained(v.outbox).select("id", "event_type", "published", "state")


@query(
    "sink_queue_route",
    f"""SELECT id, event_type, CASE event_type WHEN 'ORDER_CREATED' THEN 'order.created'
              WHEN 'PAYMENT_SUCCESS' THEN 'payment.success' ELSE 'payment.failed' END AS queue
       FROM d_outbox WHERE {_KNOWN}""",
)
def sink_queue_route(v):
    path = run_folder(v.spark, "queues")
    O.write_queues(v.outbox, path)
    return v.spark.read.parquet(path).select("id", "event_type", "queue")


# reconciliation

_ISSUES = """SELECT CASE WHEN live_qty < expected THEN 'ORPHANED_DECREMENT' ELSE 'OVER_RELEASE' END AS issue,
                    sale_id, id AS sale_product_id, product_name, live_qty, expected AS expected_qty,
                    abs(expected - live_qty) AS delta
             FROM (SELECT sp.id, sp.sale_id, p.name AS product_name, c.live_qty, sp.total_qty - count(o.id) AS expected
                   FROM d_sale_products sp JOIN d_products p ON p.id = sp.product_id
                   JOIN d_sales s ON s.id = sp.sale_id AND s.status = 'ACTIVE'
                   JOIN {counters} c ON c.sale_product_id = sp.id
                   LEFT JOIN (d_order_items i JOIN {orders} o ON o.id = i.order_id
                              AND o.status IN ('PENDING', 'CONFIRMED'))
                     ON i.product_id = sp.product_id AND o.sale_id = sp.sale_id
                   GROUP BY sp.id, sp.sale_id, p.name, c.live_qty, sp.total_qty) WHERE live_qty <> expected"""
_ISSUE_VIEW = {"x_issues": _ISSUES.format(orders="d_orders", counters="d_live_counters")}


def _issues(v):
    return C.inventory_discrepancies(
        v.sales, v.sale_products, v.products, v.orders, v.order_items, v.live_counters
    )


@query("inventory_discrepancies", "SELECT * FROM x_issues", _ISSUE_VIEW)
def inventory_discrepancies(v):
    return _issues(v)


@query(
    "repair_counters",
    """SELECT c.sale_product_id, CAST(coalesce(x.expected_qty, c.live_qty) AS INTEGER) AS live_qty
       FROM d_live_counters c LEFT JOIN x_issues x ON x.sale_product_id = c.sale_product_id""",
    _ISSUE_VIEW,
)
def repair_counters(v):
    return C.repair_counters(v.live_counters, _issues(v))


_STUCK = f"""SELECT i.id AS item_id, o.id AS order_id, o.user_id, o.total_amount, i.product_id, i.quantity, sp.id AS sale_product_id
             FROM d_orders o JOIN d_order_items i ON i.order_id = o.id
             JOIN d_sale_products sp ON sp.product_id = i.product_id AND sp.sale_id = o.sale_id
             WHERE o.status = 'PENDING' AND o.created_at < {SQL_AS_OF} - INTERVAL 15 MINUTE"""
_STUCK_VIEWS = {
    "x_stuck": _STUCK,
    "x_orders_now": """SELECT id, sale_id, user_id, CASE WHEN id IN (SELECT order_id FROM x_stuck) THEN 'FAILED'
                       ELSE status END AS status FROM d_orders""",
    "x_freed": "SELECT sale_product_id AS id, sum(quantity) AS q FROM x_stuck GROUP BY 1",
    "x_counters_now": """SELECT c.sale_product_id, CAST(c.live_qty + coalesce(f.q, 0) AS INTEGER) AS live_qty
                         FROM d_live_counters c LEFT JOIN x_freed f ON f.id = c.sale_product_id""",
    "x_issues": _ISSUES.format(orders="x_orders_now", counters="x_counters_now"),
}


def _failed(v):
    return C.fail_stuck_orders(v.orders, v.order_items, v.sale_products, v.live_counters, _at())


@query("stuck_pending_orders", "SELECT * EXCLUDE (item_id) FROM x_stuck", _STUCK_VIEWS)
def stuck_pending_orders(v):
    return C.stuck_pending_orders(v.orders, v.order_items, v.sale_products, _at()).select(
        "order_id", "user_id", "total_amount", "product_id", "quantity", "sale_product_id"
    )


@query("fail_stuck_orders", "SELECT id, status FROM x_orders_now", _STUCK_VIEWS)
def fail_stuck_orders(v):
    return _failed(v)["orders"].select("id", "status")


@query(
    "fail_stuck_orders_stock",
    """SELECT sp.id, CAST(CASE WHEN f.q IS NULL THEN reserved_qty ELSE greatest(0, reserved_qty - f.q) END AS INTEGER)
                AS reserved_qty, c.live_qty
       FROM d_sale_products sp LEFT JOIN x_freed f ON f.id = sp.id
       LEFT JOIN x_counters_now c ON c.sale_product_id = sp.id""",
    _STUCK_VIEWS,
)
def fail_stuck_orders_stock(v):
    out = _failed(v)
    levels = out["counters"].withColumnRenamed("sale_product_id", "id")
    return out["sale_products"].select("id", "reserved_qty").join(levels, "id", "left")


@query(
    "fail_stuck_orders_events",
    f"""SELECT 'PAYMENT_FAILED' AS event_type, item_id AS event_key,
              '{{"orderId":' || order_id || ',"userId":' || user_id
              || ',"reason":"{STUCK_REASON}","amount":"' || total_amount
              || '","productName":"{STUCK_PRODUCT_NAME}"}}' AS payload FROM x_stuck""",
    _STUCK_VIEWS,
)
def fail_stuck_orders_events(v):
    return _failed(v)["outbox"]


@query(
    "sync_inventory",
    f"""SELECT i.sale_product_id, coalesce(l.live_qty, i.available_qty) AS available_qty,
              CASE WHEN l.live_qty IS NOT NULL THEN {SQL_AS_OF} ELSE i.last_synced_at END AS last_synced_at
        FROM d_inventory i LEFT JOIN (SELECT c.* FROM d_live_counters c JOIN d_sale_products sp
             ON sp.id = c.sale_product_id JOIN d_sales s ON s.id = sp.sale_id AND s.status = 'ACTIVE') l
          ON l.sale_product_id = i.sale_product_id""",
)
def sync_inventory(v):
    return C.sync_inventory(v.sales, v.sale_products, v.inventory, v.live_counters, _at()).drop("id")


_STALE = f"""SELECT event_type, count(*) AS stale_events FROM d_outbox
             WHERE NOT published AND created_at < {SQL_EVENTS_AS_OF} - INTERVAL 10 MINUTE GROUP BY 1"""


@query("stale_outbox", _STALE)
def stale_outbox(v):
    return C.stale_outbox(v.outbox, _at(EVENTS_AS_OF))


def _run(v):
    return C.reconcile_run(
        v.sales, v.sale_products, v.products, v.orders, v.order_items, v.inventory, v.live_counters, v.outbox, _at(),
        _at(EVENTS_AS_OF),
    )


@query(
    "reconcile_run",
    f"""SELECT stuck_fixed, discrepancies, stale_events, stuck_fixed + discrepancies + stale_events > 0 AS has_issues
        FROM (SELECT (SELECT count(*) FROM x_stuck) AS stuck_fixed, (SELECT count(*) FROM x_issues) AS discrepancies,
                     CAST((SELECT coalesce(sum(stale_events), 0) FROM ({_STALE})) AS BIGINT) AS stale_events)""",
    _STUCK_VIEWS,
)
def reconcile_run(v):
    return _run(v)["summary"]


@query(
    "reconcile_run_counters",
    """SELECT c.sale_product_id, CAST(coalesce(x.expected_qty, c.live_qty) AS INTEGER) AS live_qty
       FROM x_counters_now c LEFT JOIN x_issues x ON x.sale_product_id = c.sale_product_id""",
    _STUCK_VIEWS,
)
def reconcile_run_counters(v):
    return _run(v)["counters"]
