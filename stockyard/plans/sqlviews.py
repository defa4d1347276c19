"""The domain views as SQL over the star-schema tables, for checking results."""

from __future__ import annotations

import re

SALES_AS_OF = "TIMESTAMP '2001-06-15 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS = {
    "d_users": """
        SELECT c_custkey AS id, replace(lower(c_name), '#', '.') || '@example.com' AS email, c_name AS full_name,
               CASE WHEN c_nationkey = 0 THEN 'admin' ELSE 'user' END AS role, c_acctbal >= 0 AS is_active,
               TIMESTAMP '1994-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at
        FROM customer""",
    "d_products": """
        SELECT p_partkey AS id, p_name AS name, CAST(NULL AS VARCHAR) AS description,
               CAST(p_retailprice AS DECIMAL(10,2)) AS base_price,
               CASE WHEN p_partkey % 3 <> 0 THEN 'products/' || p_partkey || '.png' END AS image_key,
               p_size % 10 <> 0 AS is_active,
               TIMESTAMP '1994-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER)) AS created_at
        FROM part""",
    "d_orders": """
        SELECT o_orderkey AS id, o_custkey AS user_id,
               CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS sale_id,
               o_custkey || '-' || (year(o_orderdate) * 100 + month(o_orderdate)) AS idempotency_key,
               CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'FAILED' ELSE 'CONFIRMED' END AS status,
               CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
               o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orders""",
    "d_order_items": """
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
               CAST(l_extendedprice AS DECIMAL(10,2)) AS unit_price
        FROM lineitem""",
    "d_sales": f"""
        SELECT sale_id AS id, 'Sale ' || sale_id AS name, start_time, end_time,
               CASE WHEN end_time <= {SALES_AS_OF} THEN 'ENDED'
                    WHEN start_time <= {SALES_AS_OF} THEN 'ACTIVE' ELSE 'SCHEDULED' END AS status,
               start_time AS created_at
        FROM (SELECT sale_id, start_time, start_time + INTERVAL 3 MONTH AS end_time
              FROM (SELECT DISTINCT sale_id, make_timestamp(sale_id // 100, sale_id % 100, 1, 0, 0, 0.0) AS start_time
                    FROM d_orders))""",
    "d_allocations": """
        SELECT a.sale_id * 100000000000 + a.product_id AS id, a.sale_id, a.product_id,
               CAST(p.base_price * 0.8 AS DECIMAL(10,2)) AS sale_price,
               CAST(a.units + a.product_id % 5 AS INTEGER) AS total_qty,
               CAST(a.reserved AS INTEGER) AS reserved_qty, a.live_lines
        FROM (SELECT o.sale_id, i.product_id, sum(i.quantity) AS units,
                     coalesce(sum(i.quantity) FILTER (o.status <> 'FAILED'), 0) AS reserved,
                     count(*) FILTER (o.status <> 'FAILED') AS live_lines
              FROM d_orders o JOIN d_order_items i ON i.order_id = o.id GROUP BY 1, 2) a
        JOIN d_products p ON p.id = a.product_id""",
    "d_sale_products": "SELECT id, sale_id, product_id, sale_price, total_qty, reserved_qty FROM d_allocations",
    "d_live_counters": """
        SELECT id AS sale_product_id,
               CAST(total_qty - live_lines + (product_id + sale_id) % 3 - 1 AS INTEGER) AS live_qty
        FROM d_allocations WHERE product_id % 7 <> 0""",
    "d_inventory": """
        SELECT id, id AS sale_product_id, total_qty AS available_qty,
               make_timestamp(sale_id // 100, sale_id % 100, 1, 0, 0, 0.0) AS last_synced_at
        FROM d_sale_products""",
    "d_outbox": """
        SELECT event_id AS id,
               CASE event_type WHEN 'purchase' THEN 'ORDER_CREATED' WHEN 'signup' THEN 'PAYMENT_SUCCESS'
                    WHEN 'error' THEN 'PAYMENT_FAILED' ELSE upper(event_type) END AS event_type,
               props AS payload, event_id % 3 = 0 AS published, ts AS created_at
        FROM events""",
    "d_stock_log": """
        SELECT event_id AS id, user_id, ts, event_type, CAST((day(ts) - 1) // 7 AS BIGINT) AS sale_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id
        FROM events""",
    "d_order_requests": """
        SELECT id AS request_id, user_id, ts, sale_id, product_id, CAST(1 + id % 7 AS INTEGER) AS quantity,
               CAST(1 + product_id % 3 AS INTEGER) AS total_qty
        FROM d_stock_log WHERE event_type = 'purchase'""",
    "d_stock_events": """
        SELECT id, ts, sale_id, product_id, CASE event_type WHEN 'purchase' THEN -1 ELSE 1 END AS delta
        FROM d_stock_log WHERE event_type IN ('purchase', 'error')""",
    "d_limiter_calls": "SELECT event_id AS id, user_id, epoch_us(ts) // 1000 AS ms FROM events",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `body` with the views it names, in dependency order."""
    known = {**VIEWS, **(extra or {})}
    ordered: list[str] = []
    seen: set[str] = set()

    def need(sql: str) -> None:
        for name in re.findall(r"\b[dx]_\w+\b", sql):
            if name in known and name not in seen:
                seen.add(name)
                need(known[name])
                ordered.append(name)

    need(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({known[name]})" for name in ordered)
    own = body.strip()
    if own[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {ctes},\n{own[5:]}"
    return f"WITH RECURSIVE {ctes}\n{own}"
