"""Queries: event decoding, row rules, limiters, stock ledger and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockyard.functions import scalars as S
from stockyard.operators import admission as A
from stockyard.operators import ledger as G
from stockyard.operators import limits as M
from stockyard.operators import rules as Q
from stockyard.plans.registry import query
from stockyard.plans.sqlviews import SALES_AS_OF as SQL_AS_OF
from stockyard.schemas import struct
from stockyard.sources.events import decode_events
from stockyard.sources.fixtures import SALES_AS_OF, ts

DAY, HOUR = 86_400_000, 3_600_000

# sources


@query(
    "src_event_json",
    """SELECT event_id AS id, event_id % 10 = 0 AS malformed,
              CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k
       FROM events""",
)
def src_event_json(v):
    """A tenth of the bodies is cut short and a third is wrapped in a JSON string."""
    id_, body = F.col("event_id"), F.col("props")
    wrapped = F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('\\"')), F.lit('"'))
    log = v.raw("events").select(
        id_.alias("id"),
        F.when(id_ % 10 == 0, F.substring(body, 1, 4)).when(id_ % 3 == 0, wrapped).otherwise(body).alias("payload"),
    )
    return decode_events(log, struct("k INT")).select("id", "malformed", F.col("body.k").alias("k"))


# row rules

_VERDICT = ["error_code", "http_class", "message"]

_RAW_PRODUCTS = """SELECT p_partkey AS id,
    CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' || p_name || chr(9) ELSE p_name END AS name,
    CASE p_partkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || p_type || ' ' END AS description,
    CASE p_partkey % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '-5' WHEN 2 THEN '12.5kg' WHEN 3 THEN '0' WHEN 4 THEN NULL
         ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) END AS base_price
    FROM part"""


def _spark_sql(v, sql: str, **tables):
    """Shape dirty input rows with the same SQL text on both sides."""
    return v.spark.sql(sql.replace("VARCHAR", "STRING"), **tables)


@query(
    "dq_products",
    r"""SELECT id, CASE WHEN code IS NULL THEN trim(name, ' ' || chr(9)) ELSE name END AS name,
              CASE WHEN code IS NULL THEN nullif(trim(description), '') ELSE description END AS description,
              CASE WHEN code IS NULL THEN CAST(price AS DECIMAL(10,2)) END AS price, code AS error_code,
              CASE WHEN code IS NOT NULL THEN CAST(400 AS INTEGER) END AS http_class,
              CASE code WHEN 'MISSING_FIELDS' THEN 'name and base_price are required.'
                        WHEN 'INVALID_PRICE' THEN 'base_price must be a positive number.' END AS message
       FROM (SELECT *, CASE WHEN coalesce(name, '') = '' OR coalesce(base_price, '') = '' THEN 'MISSING_FIELDS'
                            WHEN price IS NULL OR price <= 0 THEN 'INVALID_PRICE' END AS code
             FROM (SELECT *, TRY_CAST(regexp_extract(base_price, '^-?\d+\.?\d*') AS DOUBLE) AS price FROM x_raw))""",
    {"x_raw": _RAW_PRODUCTS},
)
def dq_products(v):
    raw = _spark_sql(v, _RAW_PRODUCTS.replace("FROM part", "FROM {part}"), part=v.raw("part"))
    return Q.dq_products(raw).select("id", "name", "description", "price", *_VERDICT)


_RAW_SALES = """SELECT id, CASE WHEN id % 11 = 0 THEN '' ELSE 'Sale ' || id END AS name,
    CASE WHEN id % 13 = 0 THEN 'soon' ELSE CAST(created_at AS VARCHAR) END AS start_time,
    CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(created_at AS VARCHAR) WHEN 2 THEN '1990-01-01 10:00:00'
         ELSE '2031-01-01T10:00:00Z' END AS end_time
    FROM d_orders"""


@query(
    "dq_sales",
    f"""SELECT id, code AS error_code, CASE WHEN code IS NOT NULL THEN CAST(400 AS INTEGER) END AS http_class,
              CASE code WHEN 'MISSING_FIELDS' THEN 'name, start_time and end_time are required.'
                   WHEN 'INVALID_DATE' THEN 'Invalid date format. Use ISO 8601 (e.g. 2026-03-20T14:00:00Z).'
                   WHEN 'START_NOT_FUTURE' THEN 'start_time must be in the future.'
                   WHEN 'END_BEFORE_START' THEN 'end_time must be after start_time.' END AS message, start_ts, end_ts
        FROM (SELECT *, CASE WHEN name = '' OR end_time IS NULL THEN 'MISSING_FIELDS'
                             WHEN start_ts IS NULL OR end_ts IS NULL THEN 'INVALID_DATE'
                             WHEN start_ts <= {SQL_AS_OF} THEN 'START_NOT_FUTURE'
                             WHEN end_ts <= start_ts THEN 'END_BEFORE_START' END AS code
              FROM (SELECT *, TRY_CAST(start_time AS TIMESTAMP) AS start_ts, TRY_CAST(end_time AS TIMESTAMP) AS end_ts
                    FROM x_raw))""",
    {"x_raw": _RAW_SALES},
)
def dq_sales(v):
    raw = _spark_sql(v, _RAW_SALES.replace("FROM d_orders", "FROM {o}"), o=v.orders)
    return Q.dq_sales(raw, ts(SALES_AS_OF)).select("id", *_VERDICT, "start_ts", "end_ts")


_RAW_LINES = """SELECT id, CASE WHEN sale_id % 5 = 0 THEN sale_id + 100000 WHEN product_id % 3 = 0 THEN 200108
         ELSE sale_id END AS sale_id,
    CASE WHEN product_id % 19 = 0 THEN NULL ELSE product_id END AS product_id,
    CASE product_id % 6 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN 'x' ELSE CAST(sale_price AS VARCHAR) END
      AS sale_price,
    CASE product_id % 8 WHEN 0 THEN '-1' WHEN 1 THEN '7.9' WHEN 2 THEN 'many' ELSE CAST(total_qty AS VARCHAR) END
      AS total_qty
    FROM d_sale_products"""


@query(
    "dq_sale_products",
    r"""SELECT id, code AS error_code,
              CASE WHEN code LIKE '%NOT_FOUND' THEN 404 WHEN code IS NOT NULL THEN 400 END::INTEGER AS http_class,
              CASE code WHEN 'MISSING_FIELDS' THEN 'product_id, sale_price and total_qty are required.'
                   WHEN 'INVALID_PRICE' THEN 'sale_price must be a positive number.'
                   WHEN 'INVALID_QTY' THEN 'total_qty must be a positive integer.'
                   WHEN 'SALE_NOT_FOUND' THEN 'Sale not found.'
                   WHEN 'SALE_NOT_SCHEDULED' THEN 'Cannot add products to a sale with status: ' || status || '.'
                   WHEN 'PRODUCT_NOT_FOUND' THEN 'Product not found or inactive.' END AS message, qty
       FROM (SELECT x.*, s.status, CASE WHEN x.product_id IS NULL OR sale_price = '' OR total_qty = ''
                    THEN 'MISSING_FIELDS'
               WHEN price IS NULL OR price <= 0 THEN 'INVALID_PRICE' WHEN qty IS NULL OR qty <= 0 THEN 'INVALID_QTY'
               WHEN s.id IS NULL THEN 'SALE_NOT_FOUND' WHEN s.status <> 'SCHEDULED' THEN 'SALE_NOT_SCHEDULED'
               WHEN p.id IS NULL THEN 'PRODUCT_NOT_FOUND' END AS code
             FROM (SELECT *, TRY_CAST(regexp_extract(sale_price, '^-?\d+\.?\d*') AS DOUBLE) AS price,
                          TRY_CAST(regexp_extract(total_qty, '^-?\d+') AS BIGINT) AS qty FROM x_raw) x
             LEFT JOIN d_sales s ON s.id = x.sale_id
             LEFT JOIN (SELECT id FROM d_products WHERE is_active) p ON p.id = x.product_id)""",
    {"x_raw": _RAW_LINES},
)
def dq_sale_products(v):
    raw = _spark_sql(v, _RAW_LINES.replace("FROM d_sale_products", "FROM {sp}"), sp=v.sale_products)
    return Q.dq_sale_products(raw, v.sales, v.products).select("id", *_VERDICT, "qty")


@query(
    "dq_order_requests",
    """SELECT request_id, quantity, CASE WHEN product_id % 12 = 0 THEN 'MISSING_FIELDS'
                   WHEN quantity > 5 OR request_id % 9 = 0 THEN 'INVALID_QUANTITY' END AS error_code
       FROM (SELECT request_id, product_id, CASE WHEN request_id % 9 = 0 THEN 1.5 WHEN request_id % 8 = 0 THEN 1.0
                    ELSE CAST(quantity AS DECIMAL(3,1)) END::DOUBLE AS quantity FROM d_order_requests)""",
)
def dq_order_requests(v):
    id_ = F.col("request_id")
    raw = v.order_requests.select(
        "request_id",
        "sale_id",
        F.when(F.col("product_id") % 12 != 0, F.col("product_id")).alias("sale_product_id"),
        F.when(id_ % 9 == 0, F.lit(1.5)).when(id_ % 8 != 0, F.col("quantity").cast("double")).alias("quantity"),
    )
    return Q.dq_order_requests(raw).select("request_id", "quantity", "error_code")


_RAW_SIGNUPS = """SELECT id, created_at AS ts,
    CASE WHEN id % 10 = 0 THEN '' WHEN id % 4 = 0 THEN '  New.' || (id % 97) || '@EXAMPLE.com '
         WHEN id % 4 = 1 THEN upper(email) ELSE 'new.' || (id % 211) || '@example.com' END AS email,
    CASE WHEN id % 6 = 0 THEN 'short' ELSE 'longer' || id END AS password,
    CASE WHEN id % 14 = 0 THEN NULL ELSE ' ' || full_name END AS full_name
    FROM d_users"""


@query(
    "dq_registrations",
    """SELECT id, email_key, trim(full_name) AS full_name,
              CASE WHEN own IS NULL AND (rn > 1 OR taken) THEN 'EMAIL_TAKEN' ELSE own END AS error_code
       FROM (SELECT *, row_number() OVER (PARTITION BY email_key, own IS NULL ORDER BY ts, id) AS rn,
                    email_key IN (SELECT email FROM d_users) AS taken
             FROM (SELECT *, trim(lower(email)) AS email_key,
                     CASE WHEN email = '' OR full_name IS NULL THEN 'MISSING_FIELDS'
                          WHEN length(password) < 6 THEN 'SHORT_PASSWORD' END AS own FROM x_raw))""",
    {"x_raw": _RAW_SIGNUPS},
)
def dq_registrations(v):
    raw = _spark_sql(v, _RAW_SIGNUPS.replace("FROM d_users", "FROM {u}"), u=v.users)
    return Q.dq_registrations(raw, v.users).select("id", "email_key", "full_name", "error_code")


_RAW_UPLOADS = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png'
    WHEN 2 THEN 'image/webp' WHEN 3 THEN 'image/gif' END AS mime,
    CAST(5242880 + (p_size % 3 - 1) AS BIGINT) AS size FROM part"""


@query(
    "dq_uploads",
    """SELECT id, mime, size, CASE WHEN mime = 'image/gif' THEN 'UNSUPPORTED_TYPE'
                                   WHEN size > 5242880 THEN 'FILE_TOO_LARGE' END AS error_code,
              CASE WHEN mime <> 'image/gif' AND size <= 5242880 THEN split_part(mime, '/', 2) END AS extension
       FROM x_raw""",
    {"x_raw": _RAW_UPLOADS},
)
def dq_uploads(v):
    raw = _spark_sql(v, _RAW_UPLOADS.replace("FROM part", "FROM {part}"), part=v.raw("part"))
    return Q.dq_uploads(raw).select("id", "mime", "size", "error_code", "extension")


# limiters


def limiter_sql(name: str, calls: str, limit: str, window: str) -> dict[str, str]:
    """Views that replay `calls` (key, ms, id, limit and window columns or literals) row by row."""
    return {
        f"x_{name}_calls": f"""SELECT key, ms, id, {limit} AS lim, CAST({window} AS BIGINT) AS win,
            row_number() OVER (PARTITION BY key ORDER BY ms, id) AS rn FROM ({calls})""",
        f"x_{name}": f"""
            SELECT key, CAST(0 AS BIGINT) AS ms, CAST(-1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS rn,
                   CAST([] AS BIGINT[]) AS q, false AS allowed, CAST(0 AS INTEGER) AS current_count,
                   CAST(0 AS BIGINT) AS retry_after_s, CAST(0 AS INTEGER) AS remaining
            FROM (SELECT DISTINCT key FROM x_{name}_calls)
            UNION ALL
            SELECT key, ms, id, rn, CASE WHEN len(w) < lim THEN list_append(w, ms) ELSE w END, len(w) < lim,
                   CAST(CASE WHEN len(w) < lim THEN len(w) + 1 ELSE len(w) END AS INTEGER),
                   CASE WHEN len(w) < lim THEN 0 ELSE (w[1] + win - ms + 999) // 1000 END,
                   CAST(CASE WHEN len(w) < lim THEN lim - len(w) - 1 ELSE greatest(0, lim - len(w)) END AS INTEGER)
            FROM (SELECT c.*, list_filter(p.q, lambda t: t > c.ms - c.win) AS w
                  FROM x_{name} p JOIN x_{name}_calls c ON c.key = p.key AND c.rn = p.rn + 1)""",
    }


_LIMITED = "SELECT key, ms, id, allowed, current_count, retry_after_s, remaining FROM x_lim WHERE rn > 0"
_BY_USER = "SELECT CAST(user_id AS VARCHAR) AS key, ms, id FROM d_limiter_calls"


@query("limit_sliding", _LIMITED, limiter_sql("lim", _BY_USER, "3", f"{DAY}"))
def limit_sliding(v):
    return M.limit_sliding(v.limiter_calls, F.col("user_id").cast("string"), "ms", "id", 3, DAY)


# The presets count seconds and never bite on month-long logs, so the queries widen their windows.


@query("limit_user", _LIMITED, limiter_sql("lim", _BY_USER.replace("CAST(user_id AS VARCHAR)",
       "CASE WHEN user_id % 5 = 0 THEN 'ip-' || user_id % 3 ELSE CAST(user_id AS VARCHAR) END"), "10", f"{5 * DAY}"))
def limit_user(v):
    calls = v.limiter_calls.select(
        "ms",
        "id",
        F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("user_id"),
        F.concat(F.lit("ip-"), (F.col("user_id") % 3).cast("string")).alias("ip"),
    )
    return M.limit_user(calls, "ms", "id", ip="ip", preset=(10, 5 * DAY))


@query("limit_buy", _LIMITED, limiter_sql("lim", _BY_USER, "3", f"{2 * DAY}"))
def limit_buy(v):
    return M.limit_buy(v.limiter_calls, "ms", "id", preset=(3, 2 * DAY))


@query("limit_global", _LIMITED, limiter_sql("lim", "SELECT 'orders' AS key, ms, id FROM d_limiter_calls", "10",
                                             f"{HOUR}"))
def limit_global(v):
    return M.limit_global(v.limiter_calls, "ms", "id", preset=(10, HOUR))


@query("limit_auth", _LIMITED, limiter_sql(
    "lim", "SELECT CAST('10.0.0.' || user_id % 40 AS VARCHAR) AS key, ms, id FROM d_limiter_calls", "5", f"{12 * HOUR}"))
def limit_auth(v):
    calls = v.limiter_calls.withColumn("ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 40).cast("string")))
    return M.limit_auth(calls, "ms", "id", preset=(5, 12 * HOUR))


def chain_sql(calls: str, rates: dict[str, tuple[int, int]]) -> dict[str, str]:
    """Views x_stopped(id, stopped_by, retry_after_s) over calls(user_id, ms, id)."""
    views = limiter_sql("g", f"SELECT 'orders' AS key, ms, id FROM ({calls})", *map(str, rates["global"]))
    for name, source, rate in (("u", "x_g", rates["user"]), ("b", "x_u", rates["buy"])):
        survivors = f"""SELECT CAST(c.user_id AS VARCHAR) AS key, c.ms, c.id FROM ({calls}) c
                        JOIN {source} p ON p.id = c.id AND p.rn > 0 AND p.allowed"""
        views |= limiter_sql(name, survivors, *map(str, rate))
    views["x_stopped"] = " UNION ALL ".join(
        f"SELECT id, '{label}' AS stopped_by, retry_after_s FROM x_{n} WHERE rn > 0 AND NOT allowed"
        for n, label in (("g", "global"), ("u", "user"), ("b", "buy"))
    )
    return views


RATES = {"global": (10, HOUR), "user": (5, 2 * DAY), "buy": (3, 2 * DAY)}


@query(
    "limit_chain",
    """SELECT c.user_id, c.ms, c.id, s.stopped_by, s.retry_after_s FROM d_limiter_calls c
       LEFT JOIN x_stopped s ON s.id = c.id""",
    chain_sql("SELECT * FROM d_limiter_calls", RATES),
)
def limit_chain(v):
    return M.limit_chain(v.limiter_calls, "ms", "id", presets=RATES)


@query(
    "limit_shared_key",
    "SELECT CAST(key AS BIGINT) AS user_id, ms, id, allowed, current_count, retry_after_s, remaining FROM x_lim "
    "WHERE rn > 0",
    limiter_sql(
        "lim",
        "SELECT user_id AS key, ms, id FROM d_limiter_calls",
        "CASE id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 6 END",
        f"CASE id % 3 WHEN 0 THEN {4 * DAY} WHEN 1 THEN {DAY} ELSE {2 * DAY} END",
    ),
)
def limit_shared_key(v):
    route = F.col("id") % 3
    calls = v.limiter_calls.withColumn(
        "limit", F.when(route == 0, 4).when(route == 1, 2).otherwise(6)
    ).withColumn("window_ms", F.when(route == 0, 4 * DAY).when(route == 1, DAY).otherwise(2 * DAY))
    return M.limit_rows(calls, ["user_id"], "ms", "id").drop("limit", "window_ms")


@query(
    "attempt_pressure",
    f"""SELECT key, ms, count(*) AS attempts, CAST(max(n) AS BIGINT) AS in_window
        FROM (SELECT user_id AS key, ms, count(*) OVER (PARTITION BY user_id ORDER BY ms
                RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS n FROM d_limiter_calls) GROUP BY 1, 2""",
)
def attempt_pressure(v):
    return M.attempt_pressure(v.limiter_calls, "user_id", "ms", DAY)


# stock ledger


def ledger_sql(created: str) -> dict[str, str]:
    return {
        "x_ev": """SELECT *, CASE WHEN product_id % 7 <> 0 THEN 1 + product_id % 3 END AS total_qty,
                   row_number() OVER (PARTITION BY sale_id, product_id ORDER BY ts, id) AS rn FROM d_stock_events""",
        "x_led": f"""
            SELECT DISTINCT sale_id, product_id, CAST(0 AS BIGINT) AS rn, CAST(total_qty AS INTEGER) AS level,
                   CAST(NULL AS BIGINT) AS id, CAST(NULL AS TIMESTAMP) AS ts, CAST(0 AS INTEGER) AS delta,
                   true AS success, CAST(NULL AS VARCHAR) AS reason FROM x_ev
            UNION ALL
            SELECT e.sale_id, e.product_id, e.rn,
                   CAST(CASE WHEN p.level IS NULL THEN {created} WHEN e.delta < 0 AND p.level <= 0 THEN p.level
                        ELSE p.level + e.delta END AS INTEGER),
                   e.id, e.ts, e.delta,
                   CASE WHEN p.level IS NULL THEN {created} IS NOT NULL ELSE NOT (e.delta < 0 AND p.level <= 0) END,
                   CASE WHEN e.delta < 0 THEN CASE WHEN p.level IS NULL THEN 'SALE_NOT_FOUND'
                        WHEN p.level <= 0 THEN 'OUT_OF_STOCK' END END
            FROM x_led p JOIN x_ev e ON e.sale_id = p.sale_id AND e.product_id = p.product_id AND e.rn = p.rn + 1""",
    }


_LEDGER = "SELECT sale_id, product_id, ts, id, delta, level, success, reason FROM x_led WHERE rn > 0"
_NO_COUNTER = ledger_sql("CAST(NULL AS INTEGER)")


def _ledger(v, **options):
    totals = (
        v.stock_events.select("sale_id", "product_id")
        .distinct()
        .filter("product_id % 7 != 0")
        .withColumn("total_qty", (1 + F.col("product_id") % 3).cast("int"))
    )
    return G.stock_ledger(v.stock_events, totals, A.PRODUCT, **options)


@query("stock_ledger", _LEDGER, _NO_COUNTER)
def stock_ledger(v):
    return _ledger(v)


@query(
    "stock_ledger_release_creates",
    _LEDGER,
    ledger_sql("CASE WHEN e.delta > 0 THEN e.delta END"),
)
def stock_ledger_release_creates(v):
    return _ledger(v, release_creates=True)


def quantity_sql(created: str) -> dict[str, str]:
    return {
        "x_qev": """SELECT sale_id, product_id, ts, id, CAST(delta * (1 + id % 4) AS INTEGER) AS delta,
                    CASE WHEN product_id % 7 <> 0 THEN 3 + product_id % 5 END AS total_qty,
                    row_number() OVER (PARTITION BY sale_id, product_id ORDER BY ts, id) AS rn FROM d_stock_events""",
        "x_qled": f"""
            SELECT DISTINCT sale_id, product_id, CAST(0 AS BIGINT) AS rn, CAST(total_qty AS INTEGER) AS level,
                   CAST(NULL AS BIGINT) AS id, CAST(NULL AS TIMESTAMP) AS ts, CAST(0 AS INTEGER) AS delta,
                   true AS success, CAST(NULL AS VARCHAR) AS reason FROM x_qev
            UNION ALL
            SELECT e.sale_id, e.product_id, e.rn,
                   CAST(CASE WHEN p.level IS NULL THEN {created} WHEN p.level + e.delta < 0 THEN p.level
                        ELSE p.level + e.delta END AS INTEGER),
                   e.id, e.ts, e.delta,
                   CASE WHEN p.level IS NULL THEN {created} IS NOT NULL ELSE p.level + e.delta >= 0 END,
                   CASE WHEN e.delta < 0 THEN CASE WHEN p.level IS NULL THEN 'SALE_NOT_FOUND'
                        WHEN p.level + e.delta < 0 THEN 'OUT_OF_STOCK' END END
            FROM x_qled p JOIN x_qev e ON e.sale_id = p.sale_id AND e.product_id = p.product_id AND e.rn = p.rn + 1""",
    }


_QUANTITY_LEDGER = _LEDGER.replace("x_led", "x_qled")


def _quantity_ledger(v, **options):
    quantity = F.col("delta") * (1 + F.col("id") % 4)
    totals = v.stock_events.select("sale_id", "product_id").distinct().filter("product_id % 7 != 0")
    totals = totals.withColumn("total_qty", (3 + F.col("product_id") % 5).cast("int"))
    events = v.stock_events.withColumn("delta", quantity.cast("int"))
    return G.stock_ledger(events, totals, A.PRODUCT, units="quantity", **options)


@query("stock_ledger_by_quantity", _QUANTITY_LEDGER, quantity_sql("CAST(NULL AS INTEGER)"))
def stock_ledger_by_quantity(v):
    return _quantity_ledger(v)


@query(
    "stock_ledger_by_quantity_release_creates",
    _QUANTITY_LEDGER,
    quantity_sql("CASE WHEN e.delta > 0 THEN e.delta END"),
)
def stock_ledger_by_quantity_release_creates(v):
    return _quantity_ledger(v, release_creates=True)


@query(
    "feed_inventory_changes",
    "SELECT sale_id, product_id, ts, id, level AS available_qty FROM x_led WHERE rn > 0 AND success",
    _NO_COUNTER,
)
def feed_inventory_changes(v):
    return G.feed_inventory_changes(_ledger(v), A.PRODUCT)


# admission


@query(
    "idempotent_dedupe",
    """SELECT id, idempotency_key, first_value(id) OVER w AS first_id, id <> first_value(id) OVER w AS is_duplicate
       FROM d_orders WINDOW w AS (PARTITION BY idempotency_key ORDER BY created_at, id)""",
)
def idempotent_dedupe(v):
    log = v.orders.select("id", "idempotency_key", F.col("created_at").alias("ts"))
    return A.idempotent_dedupe(log).drop("ts")


_VISITS = """SELECT o.id AS order_id, i.product_id + (CASE WHEN o.id % 9 = 0 THEN 5000000 ELSE 0 END) AS product_id,
    CASE WHEN o.id % 8 = 0 THEN o.sale_id + 100000 ELSE o.sale_id END AS sale_id,
    o.created_at + to_days(CAST(o.id % 120 - 10 AS INTEGER)) AS ts
    FROM d_orders o JOIN d_order_items i ON i.order_id = o.id"""


@query(
    "gate_sale_and_product",
    """SELECT order_id, product_id, sale_id, ts, sale_status,
              CASE WHEN sale_status IS NULL THEN 'SALE_NOT_FOUND' WHEN sale_status <> 'ACTIVE' THEN 'SALE_NOT_ACTIVE'
                   WHEN NOT offered THEN 'PRODUCT_NOT_IN_SALE' END AS gate
       FROM (SELECT r.*, CASE WHEN s.id IS NULL THEN NULL WHEN s.id % 17 = 0 THEN 'ENDED'
                         WHEN r.ts < s.start_time THEN 'SCHEDULED' WHEN r.ts >= s.end_time THEN 'ENDED'
                         ELSE 'ACTIVE' END AS sale_status, sp.id IS NOT NULL AS offered
             FROM x_visits r LEFT JOIN d_sales s ON s.id = r.sale_id
             LEFT JOIN d_sale_products sp ON sp.sale_id = r.sale_id AND sp.product_id = r.product_id)""",
    {"x_visits": _VISITS},
)
def gate_sale_and_product(v):
    sales = v.sales.withColumn("cancelled", F.col("id") % 17 == 0)
    return A.gate_sale_and_product(_visits(v), sales, v.sale_products).select(
        "order_id", "product_id", "sale_id", "ts", "sale_status", "gate"
    )


def _visits(v):
    heads = v.orders.select(F.col("id").alias("order_id"), "sale_id", F.col("created_at").alias("ts"))
    o = F.col("order_id")
    return v.order_items.select("order_id", "product_id").join(heads, "order_id").select(
        "order_id",
        (F.col("product_id") + F.when(o % 9 == 0, 5000000).otherwise(0)).alias("product_id"),
        F.when(o % 8 == 0, F.col("sale_id") + 100000).otherwise(F.col("sale_id")).alias("sale_id"),
        F.expr("ts + make_dt_interval(cast(order_id % 120 - 10 AS INT))").alias("ts"),
    )


_CHANGES = """SELECT id AS sale_id, start_time AS changed_at, CAST(1 AS INTEGER) AS seq, 'ACTIVE' AS status FROM d_sales
    UNION ALL SELECT id, start_time - to_days(5), 0, 'SCHEDULED' FROM d_sales
    UNION ALL SELECT id, end_time, 2, 'ENDED' FROM d_sales
    UNION ALL SELECT id, start_time + to_days(20), 3, 'ENDED' FROM d_sales WHERE id % 5 = 0
    UNION ALL SELECT id, start_time + to_days(20), 4, 'SCHEDULED' FROM d_sales WHERE id % 10 = 0
    UNION ALL SELECT id, start_time + to_days(40), 5, 'ACTIVE' FROM d_sales WHERE id % 10 = 0"""


@query(
    "gate_as_of_change",
    """SELECT v.order_id, v.product_id, v.sale_id, v.ts, c.status AS sale_status,
              CASE WHEN c.status IS NULL THEN 'SALE_NOT_FOUND' WHEN c.status <> 'ACTIVE' THEN 'SALE_NOT_ACTIVE'
                   WHEN sp.id IS NULL THEN 'PRODUCT_NOT_IN_SALE' END AS gate
       FROM x_visits v
       ASOF LEFT JOIN (SELECT sale_id, changed_at, arg_max(status, seq) AS status FROM x_changes GROUP BY 1, 2) c
         ON v.sale_id = c.sale_id AND v.ts >= c.changed_at
       LEFT JOIN d_sale_products sp ON sp.sale_id = v.sale_id AND sp.product_id = v.product_id""",
    {"x_visits": _VISITS, "x_changes": _CHANGES},
)
def gate_as_of_change(v):
    def change(at, seq, status, which="true"):
        return v.sales.filter(which).select(
            F.col("id").alias("sale_id"), F.expr(at).alias("changed_at"), F.lit(seq).alias("seq"), F.lit(status).alias("status")
        )

    changes = change("start_time", 1, "ACTIVE").unionByName(change("start_time - interval 5 days", 0, "SCHEDULED"))
    changes = changes.unionByName(change("end_time", 2, "ENDED"))
    changes = changes.unionByName(change("start_time + interval 20 days", 3, "ENDED", "id % 5 = 0"))
    changes = changes.unionByName(change("start_time + interval 20 days", 4, "SCHEDULED", "id % 10 = 0"))
    changes = changes.unionByName(change("start_time + interval 40 days", 5, "ACTIVE", "id % 10 = 0"))
    return A.gate_as_of(_visits(v), changes, v.sale_products, "order_id").select(
        "order_id", "product_id", "sale_id", "ts", "sale_status", "gate"
    )


def admission_sql(log: str) -> dict[str, str]:
    """Row-by-row admission of `log` (sale_id, product_id, ts, id, kind, user_id, total_qty)."""
    return {
        "x_log": f"""SELECT *, row_number() OVER (PARTITION BY sale_id, product_id ORDER BY ts, id) AS rn
                     FROM ({log})""",
        "x_adm": """
            SELECT DISTINCT sale_id, product_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id,
                   CAST(total_qty AS INTEGER) AS level, CAST([] AS BIGINT[]) AS live, CAST('' AS VARCHAR) AS outcome
            FROM x_log
            UNION ALL
            SELECT sale_id, product_id, rn, id,
                   CAST(CASE outcome WHEN 'ADMITTED' THEN level - 1 WHEN 'RELEASED' THEN level + 1 ELSE level END
                        AS INTEGER),
                   CASE outcome WHEN 'ADMITTED' THEN list_append(live, user_id)
                        WHEN 'RELEASED' THEN list_filter(live, lambda u: u <> user_id) ELSE live END, outcome
            FROM (SELECT l.*, p.level, p.live,
                    CASE WHEN l.kind = 'release'
                           THEN CASE WHEN list_contains(p.live, l.user_id) THEN 'RELEASED' ELSE 'IGNORED' END
                         WHEN list_contains(p.live, l.user_id) THEN 'ALREADY_PURCHASED'
                         WHEN p.level IS NULL THEN 'SALE_NOT_FOUND' WHEN p.level <= 0 THEN 'OUT_OF_STOCK'
                         ELSE 'ADMITTED' END AS outcome
                  FROM x_adm p JOIN x_log l
                    ON l.sale_id = p.sale_id AND l.product_id = p.product_id AND l.rn = p.rn + 1)""",
    }


# Ten buyers share the log, so that repeat purchases are common.
_REQUESTS = """SELECT sale_id, product_id, ts, request_id AS id, 'request' AS kind, user_id % 10 AS user_id,
    quantity, CASE WHEN product_id % 11 <> 0 THEN total_qty END AS total_qty
    FROM d_order_requests WHERE quantity <= 5"""


def _few_buyers(v):
    return v.order_requests.withColumn("user_id", F.col("user_id") % 10)


def _log_with_releases(v):
    """Each request, and for every other one a release 36 hours later."""
    tries = _few_buyers(v).filter("quantity <= 5")
    later = F.expr("ts + INTERVAL 36 HOURS").alias("ts")
    id_ = F.col("request_id") * 2

    def rows(df, at, number, kind):
        return df.select(*A.PRODUCT, at, number.alias("id"), F.lit(kind).alias("kind"), "user_id", "quantity")

    released = tries.filter("request_id % 2 = 0")
    return rows(tries, F.col("ts"), id_, "request").unionByName(rows(released, later, id_ + 1, "release"))


def _allocation(v):
    return v.order_requests.filter("product_id % 11 != 0").select(*A.PRODUCT, "total_qty").distinct()


@query(
    "admit_requests",
    """SELECT l.sale_id, l.product_id, l.user_id, l.ts, l.id AS request_id, a.outcome,
              CASE WHEN a.outcome = 'ADMITTED' THEN a.level END AS items_remaining
       FROM x_log l JOIN x_adm a ON a.id = l.id""",
    admission_sql(_REQUESTS),
)
def admit_requests(v):
    log = _few_buyers(v).filter("quantity <= 5").select(*A.PRODUCT, "user_id", "ts", "request_id")
    return A.admit_requests(log, _allocation(v))


@query(
    "admit_with_releases",
    """SELECT l.sale_id, l.product_id, l.user_id, l.kind, l.ts, l.id, a.outcome, a.level AS items_remaining
       FROM x_log l JOIN x_adm a ON a.id = l.id""",
    admission_sql(
        f"""SELECT sale_id, product_id, ts, id * 2 AS id, kind, user_id, total_qty FROM ({_REQUESTS})
            UNION ALL SELECT sale_id, product_id, ts + INTERVAL 36 HOUR, id * 2 + 1, 'release', user_id, total_qty
            FROM ({_REQUESTS}) WHERE id % 2 = 0"""
    ),
)
def admit_with_releases(v):
    return A.admit_with_releases(_log_with_releases(v), _allocation(v))


@query(
    "admit_with_releases_by_quantity",
    """SELECT l.sale_id, l.product_id, l.user_id, l.kind, l.ts, l.id, a.outcome, a.level AS items_remaining
       FROM x_log l JOIN x_adm a ON a.id = l.id""",
    {
        "x_log": f"""SELECT *, row_number() OVER (PARTITION BY sale_id, product_id ORDER BY ts, id) AS rn FROM (
            SELECT sale_id, product_id, ts, id * 2 AS id, kind, user_id, quantity, total_qty * 5 AS total_qty
            FROM ({_REQUESTS}) UNION ALL
            SELECT sale_id, product_id, ts + INTERVAL 36 HOUR, id * 2 + 1, 'release', user_id, quantity, total_qty * 5
            FROM ({_REQUESTS}) WHERE id % 2 = 0)""",
        "x_adm": """
            SELECT DISTINCT sale_id, product_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id,
                   CAST(total_qty AS INTEGER) AS level, MAP {CAST(-1 AS BIGINT): CAST(0 AS INTEGER)} AS live,
                   CAST('' AS VARCHAR) AS outcome
            FROM x_log
            UNION ALL
            SELECT sale_id, product_id, rn, id,
                   CAST(CASE outcome WHEN 'ADMITTED' THEN level - quantity WHEN 'RELEASED' THEN level + held
                        ELSE level END AS INTEGER),
                   CASE outcome WHEN 'ADMITTED' THEN map_concat(live, MAP {user_id: quantity})
                        WHEN 'RELEASED' THEN map_concat(live, MAP {user_id: CAST(0 AS INTEGER)}) ELSE live END,
                   outcome
            FROM (SELECT *, CASE WHEN kind = 'release' THEN CASE WHEN held > 0 THEN 'RELEASED' ELSE 'IGNORED' END
                         WHEN held > 0 THEN 'ALREADY_PURCHASED' WHEN level IS NULL THEN 'SALE_NOT_FOUND'
                         WHEN level < quantity THEN 'OUT_OF_STOCK' ELSE 'ADMITTED' END AS outcome
                  FROM (SELECT l.*, p.level, p.live, coalesce(p.live[l.user_id], 0) AS held
                        FROM x_adm p JOIN x_log l
                          ON l.sale_id = p.sale_id AND l.product_id = p.product_id AND l.rn = p.rn + 1))""",
    },
)
def admit_with_releases_by_quantity(v):
    stock = _allocation(v).withColumn("total_qty", F.col("total_qty") * 5)
    return A.admit_with_releases(_log_with_releases(v), stock, units="quantity")


_OFFER = """SELECT sale_id * 1000 + x.product_id AS id, x.sale_id, x.product_id,
    CAST(p.base_price * 0.8 AS DECIMAL(10,2)) AS sale_price, CAST(1 + x.product_id % 3 AS INTEGER) AS total_qty,
    CAST(x.product_id % 4 AS INTEGER) AS reserved_qty, p.name AS product_name
    FROM (SELECT DISTINCT sale_id, product_id FROM d_stock_log WHERE product_id % 10 <> 9) x
    JOIN d_products p ON p.id = x.product_id"""


def _offer(v):
    pairs = v._stock_log.filter("product_id % 10 != 9").select(*A.PRODUCT).distinct()
    return pairs.join(v.products.select(F.col("id").alias("product_id"), "base_price"), "product_id").select(
        (F.col("sale_id") * 1000 + F.col("product_id")).alias("id"),
        "sale_id",
        "product_id",
        (F.col("base_price") * F.expr("0.8BD")).cast("decimal(10,2)").alias("sale_price"),
        (1 + F.col("product_id") % 3).cast("int").alias("total_qty"),
        (F.col("product_id") % 4).cast("int").alias("reserved_qty"),
    )


_WON = """SELECT l.*, 'key-' || l.id AS idempotency_key, o.id AS sale_product_id, o.sale_price AS unit_price,
                 o.product_name, md5('order:' || l.id) AS order_id,
                 CAST(o.sale_price * l.quantity AS DECIMAL(10,2)) AS total_amount
          FROM x_log l JOIN x_adm a ON a.id = l.id AND a.outcome = 'ADMITTED'
          JOIN x_offer o ON o.sale_id = l.sale_id AND o.product_id = l.product_id"""
_WON_VIEWS = {**admission_sql(_REQUESTS), "x_offer": _OFFER, "x_won": _WON}


def _materialized(v):
    log = _few_buyers(v).filter("quantity <= 5")
    admitted = A.admit_requests(log.select(*A.PRODUCT, "user_id", "ts", "request_id", "quantity"), _allocation(v))
    won = admitted.filter("outcome = 'ADMITTED'").withColumn(
        "idempotency_key", F.concat(F.lit("key-"), F.col("request_id").cast("string"))
    )
    return A.materialize_orders(won, _offer(v), v.products)


@query(
    "materialize_orders",
    """SELECT order_id AS id, user_id, sale_id, idempotency_key, 'PENDING' AS status, total_amount, ts AS created_at,
              ts AS updated_at, product_id, quantity, unit_price,
              '{"orderId":"' || order_id || '","userId":' || user_id || ',"saleId":' || sale_id
              || ',"saleProductId":' || sale_product_id || ',"productId":' || product_id || ',"productName":"'
              || product_name || '","quantity":' || quantity || ',"unitPrice":' || unit_price || ',"totalAmount":"'
              || total_amount || '","idempotencyKey":"' || idempotency_key || '"}' AS payload
       FROM x_won""",
    _WON_VIEWS,
)
def materialize_orders(v):
    frames = _materialized(v)
    events = frames["outbox"].select(F.col("event_key").alias("id"), "payload")
    items = frames["order_items"].drop("id").withColumnRenamed("order_id", "id")
    return frames["orders"].join(items, "id").join(events, "id")


@query(
    "materialize_reserved_qty",
    """SELECT o.id, CAST(o.reserved_qty + coalesce(sum(w.quantity), 0) AS INTEGER) AS reserved_qty
       FROM x_offer o LEFT JOIN x_won w ON w.sale_product_id = o.id GROUP BY o.id, o.reserved_qty""",
    _WON_VIEWS,
)
def materialize_reserved_qty(v):
    return _materialized(v)["sale_products"].select("id", "reserved_qty")


_TRIES = """SELECT request_id AS id, user_id % 10 AS user_id, ts, epoch_us(ts) // 1000 AS ms, sale_id, product_id,
    quantity, CASE WHEN request_id % 4 <> 0 THEN (user_id % 10) || '-' || product_id END AS idempotency_key
    FROM d_order_requests"""
FUNNEL_RATES = {"global": (6, HOUR), "user": (8, 2 * DAY), "buy": (6, 2 * DAY)}
_COMPETE = """SELECT g.sale_id, g.product_id, g.ts, g.id, 'request' AS kind, g.user_id, g.total_qty
              FROM x_gated g WHERE g.stop IS NULL"""
_FUNNEL_VIEWS = {
    **chain_sql("SELECT user_id, ms, id FROM x_tries", FUNNEL_RATES),
    "x_tries": _TRIES,
    "x_offer": _OFFER,
    "x_weeks": """SELECT DISTINCT sale_id AS id, TIMESTAMP '2024-01-01' + to_days(CAST(7 * sale_id AS INTEGER))
                  AS start_time FROM d_stock_log""",
    "x_ok": """SELECT t.*, coalesce(idempotency_key, 'request:' || id) AS k FROM x_tries t
               WHERE quantity <= 5 AND id NOT IN (SELECT id FROM x_stopped)""",
    "x_gated": """
        SELECT o.*, f.total_qty, CASE
                 WHEN (o.user_id, o.sale_id, o.product_id)
                      <> first_value((o.user_id, o.sale_id, o.product_id)) OVER (PARTITION BY k ORDER BY o.ts, o.id)
                   THEN 'KEY_CONFLICT'
                 WHEN w.id = 3 OR o.ts >= w.start_time + INTERVAL 6 DAY THEN 'SALE_NOT_ACTIVE'
                 WHEN f.id IS NULL THEN 'PRODUCT_NOT_IN_SALE'
                 WHEN h.user_id IS NOT NULL THEN 'ALREADY_PURCHASED' END AS stop
        FROM x_ok o JOIN x_weeks w ON w.id = o.sale_id
        LEFT JOIN x_offer f ON f.sale_id = o.sale_id AND f.product_id = o.product_id
        LEFT JOIN (SELECT DISTINCT user_id % 10 AS user_id, sale_id, product_id FROM d_stock_log
                   WHERE event_type = 'signup') h
          ON h.user_id = o.user_id AND h.sale_id = o.sale_id AND h.product_id = o.product_id""",
    **admission_sql(_COMPETE),
    "x_funnel": """
        SELECT t.id AS request_id, t.user_id, t.ts, t.sale_id, t.product_id, t.quantity, t.idempotency_key,
               CASE WHEN s.id IS NOT NULL THEN 'RATE_LIMITED_' || upper(s.stopped_by)
                    WHEN t.quantity > 5 THEN 'INVALID_QUANTITY'
                    WHEN EXISTS (SELECT 1 FROM x_adm b JOIN x_gated y ON y.id = b.id WHERE b.outcome = 'ADMITTED'
                                 AND y.k = g.k AND (y.ts, y.id) < (t.ts, t.id)) THEN 'DUPLICATE'
                    ELSE coalesce(g.stop, a.outcome) END AS outcome,
               CASE WHEN a.outcome = 'ADMITTED' THEN a.level END AS items_remaining
        FROM x_tries t LEFT JOIN x_stopped s ON s.id = t.id LEFT JOIN x_gated g ON g.id = t.id
        LEFT JOIN x_adm a ON a.id = t.id""",
}


def _funnel(v):
    sales = v._stock_log.select(F.col("sale_id").alias("id")).distinct().select(
        "id",
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(cast(7 * id AS INT))").alias("start_time"),
        F.expr("TIMESTAMP_NTZ'2024-01-07 00:00:00' + make_dt_interval(cast(7 * id AS INT))").alias("end_time"),
        (F.col("id") == 3).alias("cancelled"),
    )
    requests = _few_buyers(v).select(
        "request_id",
        "user_id",
        "ts",
        S.epoch_millis(F.col("ts")).alias("ms"),
        *A.PRODUCT,
        (F.col("sale_id") * 1000 + F.col("product_id")).alias("sale_product_id"),
        "quantity",
        F.when(
            F.col("request_id") % 4 != 0,
            F.concat_ws("-", F.col("user_id").cast("string"), F.col("product_id").cast("string")),
        ).alias("idempotency_key"),
    )
    prior = v._stock_log.filter("event_type = 'signup'").withColumn("user_id", F.col("user_id") % 10)
    return A.admission_funnel(requests, sales, _offer(v), prior, FUNNEL_RATES)


@query("admission_funnel", "SELECT * FROM x_funnel", _FUNNEL_VIEWS)
def admission_funnel(v):
    return _funnel(v)


@query(
    "admission_funnel_counts",
    "SELECT sale_id, outcome, count(*) AS n FROM x_funnel GROUP BY 1, 2",
    _FUNNEL_VIEWS,
)
def admission_funnel_counts(v):
    return A.funnel_counts(_funnel(v))
