"""Queries: sources, listings, joins, aggregates and display figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions import scalars as S
from stockyard.operators import listings as L
from stockyard.operators import reports as R
from stockyard.operators import sketches as K
from stockyard.operators.nesting import digest
from stockyard.plans.registry import query
from stockyard.plans.sqlviews import SALES_AS_OF as SQL_AS_OF
from stockyard.session import store
from stockyard.sources import counters as C
from stockyard.sources.fixtures import SALES_AS_OF, Fixtures, ts
from stockyard.sources.tables import conform

BASE_URL = "http://images.example.com/sale-products"
# Small, so that large groups are split in the checked queries too.
NEST, ORDER_NEST = 250, 2

# Per relation: columns whose values are compared, besides the count: their sums.
_SUMS = {
    "users": "id, CAST(is_active AS INTEGER), length(email), length(full_name), year(created_at)",
    "products": "id, CAST(base_price*100 AS BIGINT), length(name), length(image_key), year(created_at)",
    "sales": "id, year(start_time), month(end_time), length(status), length(name)",
    "sale_products": "id%1000007, sale_id, product_id, CAST(sale_price*100 AS BIGINT), total_qty+2*reserved_qty",
    "inventory": "id%1000007, sale_product_id%1000003, available_qty, year(last_synced_at), month(last_synced_at)",
    "orders": "id, user_id+3*sale_id, CAST(total_amount*100 AS BIGINT), length(status)+5*length(idempotency_key), month(created_at)",
    "outbox": "id, length(event_type), length(payload), CAST(published AS INTEGER), hour(created_at)",
    "order_items": "order_id, product_id, quantity, CAST(unit_price*100 AS BIGINT), length(id)",
}


def _summed(relation: str) -> str:
    sums = ", ".join(f"CAST(sum({e}) AS BIGINT) AS sum_{k}" for k, e in enumerate(_SUMS[relation].split(", ")))
    return f"SELECT '{relation}' AS relation, count(*) AS n_rows, {sums} FROM "


@query("src_tables", " UNION ALL ".join(f"{_summed(r)} d_{r}" for r in _SUMS))
def src_tables(v: Fixtures) -> DataFrame:
    parts = [v.spark.sql(_summed(r) + "{t}", t=conform(getattr(v, r), r)) for r in _SUMS]
    return reduce(DataFrame.unionByName, parts)


@query(
    "src_live_counters",
    """SELECT sp.id AS sale_product_id, sp.total_qty, c.live_qty
       FROM d_sale_products sp LEFT JOIN d_live_counters c ON c.sale_product_id = sp.id""",
)
def src_live_counters(v):
    return C.with_live_qty(v.sale_products.withColumnRenamed("id", "sale_product_id"), v.live_counters).select(
        "sale_product_id", "total_qty", "live_qty"
    )


@query(
    "list_active_products",
    f"""SELECT id, name, description, base_price, image_key, is_active, created_at,
              row_number() OVER (ORDER BY created_at DESC, id) AS position,
              '{BASE_URL}/' || image_key AS image_url
       FROM d_products WHERE is_active ORDER BY created_at DESC, id LIMIT 20 OFFSET 20""",
)
def list_active_products(v):
    return L.list_active_products(v.products, BASE_URL, page_no=2, limit=20)


_SALE_ITEM = (
    "concat_ws(',', sp.id, sp.product_id, p.name, p.description, p.image_key, sp.sale_price, sp.total_qty, "
    "sp.reserved_qty)"
)
_SALE_DOCS = f"""
    WITH chosen AS ({{chosen}}),
    lines AS (SELECT c.id, {_SALE_ITEM} AS item, row_number() OVER (PARTITION BY c.id ORDER BY sp.id) AS n
              FROM chosen c JOIN d_sale_products sp ON sp.sale_id = c.id JOIN d_products p ON p.id = sp.product_id
              LEFT JOIN d_live_counters l ON l.sale_product_id = sp.id),
    docs AS (SELECT id, CAST((n - 1) // {NEST} AS INTEGER) AS part, string_agg(item, '|' ORDER BY n) AS products
             FROM lines GROUP BY 1, 2)
    SELECT {{position}} c.id, c.name, c.start_time, c.end_time, c.status, c.created_at, d.part, d.products
    FROM chosen c LEFT JOIN docs d ON d.id = c.id"""


def _flat(df, column, fields):
    return df.withColumn(column, F.when(F.col(column).isNotNull(), digest(column, fields)))


@query(
    "list_sales_catalog",
    _SALE_DOCS.format(
        chosen="""SELECT *, row_number() OVER (ORDER BY start_time DESC, id) AS position FROM d_sales
                  WHERE status = 'ENDED' ORDER BY start_time DESC, id LIMIT 10""",
        position="c.position,",
    ),
)
def list_sales_catalog(v):
    page = L.list_sales_catalog(v.sales, v.sale_products, v.products, status="ended", max_items=NEST)
    return _flat(page, "products", L.SALE_PRODUCT_FIELDS)


@query(
    "sale_detail_live",
    """SELECT s.id AS sale_id, s.name, s.status, sp.id AS sale_product_id, p.name AS product_name, sp.sale_price,
              sp.total_qty,
              CASE WHEN s.status = 'ACTIVE' AND sp.id IS NOT NULL THEN coalesce(c.live_qty, 0) END AS available_qty
       FROM d_sales s LEFT JOIN d_sale_products sp ON sp.sale_id = s.id LEFT JOIN d_products p ON p.id = sp.product_id
       LEFT JOIN d_live_counters c ON c.sale_product_id = sp.id""",
)
def sale_detail_live(v):
    return L.sale_detail_rows(v.sales, v.sale_products, v.products, v.live_counters).select(
        "sale_id", "name", "status", "sale_product_id", "product_name", "sale_price", "total_qty", "available_qty"
    )


@query(
    "sale_detail_document",
    _SALE_DOCS.format(chosen="SELECT * FROM d_sales", position="").replace(
        _SALE_ITEM,
        _SALE_ITEM[:-1] + ", CASE WHEN c.status = 'ACTIVE' THEN coalesce(l.live_qty, 0) END)",
    ),
)
def sale_detail_document(v):
    v.store_allocations()
    docs = L.sale_detail_live(v.sales, v.sale_products, v.products, v.live_counters, max_items=NEST)
    return _flat(docs, "products", [*L.SALE_PRODUCT_FIELDS, "available_qty"])


_ORDER_DOCS = f"""
    WITH listed AS (SELECT DISTINCT order_id FROM d_order_items i JOIN d_products p ON p.id = i.product_id),
    chosen AS ({{chosen}}),
    lines AS (SELECT o.*, concat_ws(',', {{item}}) AS item, row_number() OVER (PARTITION BY o.id ORDER BY {{item}}) AS n
              FROM chosen o JOIN d_order_items i ON i.order_id = o.id JOIN d_products p ON p.id = i.product_id)
    SELECT {{head}}, CAST((n - 1) // {ORDER_NEST} AS INTEGER) AS part, string_agg(item, '|' ORDER BY n) AS items
    FROM lines o GROUP BY ALL"""


@query(
    "list_user_orders",
    _ORDER_DOCS.format(
        chosen="""SELECT * FROM (SELECT o.*, s.name AS sale_name,
                    row_number() OVER (PARTITION BY user_id ORDER BY o.created_at DESC, o.id) AS position
                  FROM d_orders o JOIN d_sales s ON s.id = o.sale_id
                  WHERE o.id IN (SELECT order_id FROM listed)) WHERE position <= 5""",
        head="o.position, o.id, o.user_id, o.sale_id, o.status, o.total_amount, o.created_at, o.updated_at, o.sale_name",
        item="i.product_id, p.name, i.quantity, i.unit_price",
    ),
)
def list_user_orders(v):
    pages = L.list_user_orders(v.orders, v.sales, v.order_items, v.products, limit=5, max_items=ORDER_NEST)
    return _flat(pages, "items", ["product_id", "product_name", "quantity", "unit_price"])


@query(
    "order_detail",
    _ORDER_DOCS.format(
        chosen="SELECT o.*, s.name AS sale_name FROM d_orders o JOIN d_sales s ON s.id = o.sale_id",
        head="o.id, o.user_id, o.sale_id, o.idempotency_key, o.status, o.total_amount, o.created_at, o.updated_at, "
        "o.sale_name",
        item="i.product_id, p.name, i.quantity, i.unit_price",
    ),
)
def order_detail(v):
    docs = L.order_detail(v.orders, v.sales, v.order_items, v.products, max_items=ORDER_NEST)
    return _flat(docs, "items", ["product_id", "product_name", "quantity", "unit_price"])


@query(
    "list_admin_orders",
    _ORDER_DOCS.format(
        chosen="""SELECT o.*, u.email AS user_email, u.full_name AS user_name, s.name AS sale_name,
                         row_number() OVER (ORDER BY o.created_at DESC, o.id) AS position
                  FROM d_orders o JOIN d_users u ON u.id = o.user_id JOIN d_sales s ON s.id = o.sale_id
                  WHERE o.status = 'CONFIRMED' AND o.id IN (SELECT order_id FROM listed)
                  ORDER BY o.created_at DESC, o.id LIMIT 20 OFFSET 20""",
        head="o.position, o.id, o.status, o.total_amount, o.created_at, o.updated_at, o.user_email, o.user_name, "
        "o.sale_name",
        item="p.name, i.quantity, i.unit_price",
    ),
)
def list_admin_orders(v):
    pages = L.list_admin_orders(
        v.orders, v.users, v.sales, v.order_items, v.products, status="confirmed", page_no=2, limit=20,
        max_items=ORDER_NEST,
    )
    return _flat(pages, "items", ["product_name", "quantity", "unit_price"])


_SPEND = """SELECT u.id, u.email, u.full_name, u.role, u.is_active, u.created_at, count(o.id) AS order_count,
       CAST(coalesce(sum(o.total_amount) FILTER (o.status = 'CONFIRMED'), 0) AS DECIMAL(20,2)) AS total_spent
   FROM d_users u LEFT JOIN d_orders o ON o.user_id = u.id GROUP BY ALL"""


@query(
    "list_users_spend_page",
    f"""SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS position FROM ({_SPEND})
        ORDER BY created_at DESC, id LIMIT 20 OFFSET 40""",
)
def list_users_spend_page(v):
    return R.list_users_spend(v.users, v.orders, page_no=3, limit=20)


@query(
    "pagination_meta",
    """SELECT 'products' AS listing, count(*) AS total, CAST(1 AS BIGINT) AS page, CAST(10 AS BIGINT) AS "limit",
              CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages FROM d_products WHERE is_active
       UNION ALL SELECT 'sales', count(*), 1, 50, CAST(ceil(count(*) / 50.0) AS BIGINT) FROM d_sales
       UNION ALL SELECT 'orders', count(*), 3, 20, CAST(ceil(count(*) / 20.0) AS BIGINT) FROM d_orders
       UNION ALL SELECT 'users', count(*), 1, 20, CAST(ceil(count(*) / 20.0) AS BIGINT) FROM d_users""",
)
def pagination_meta(v):
    pages = {
        "products": (v.products.filter("is_active"), *S.clamp_page(1, 0)[:2]),
        "sales": (v.sales, *S.clamp_page("1", "100")[:2]),
        "orders": (v.orders, 3, 20),
        "users": (v.users, 1, 20),
    }
    metas = [L.pagination_meta(*p).withColumn("listing", F.lit(name)) for name, p in pages.items()]
    return reduce(DataFrame.unionByName, metas)


@query(
    "dynamic_filter",
    """SELECT id, status, total_amount FROM d_orders WHERE status = 'PENDING' AND total_amount >= 100000""",
)
def dynamic_filter(v):
    return L.where_all(v.orders, L.status_is("pending"), L.status_is(None), F.col("total_amount") >= 100000).select(
        "id", "status", "total_amount"
    )


@query("product_image_url", f"SELECT id, '{BASE_URL}/' || image_key AS image_url FROM d_products")
def product_image_url(v):
    return v.products.select("id", S.image_url(F.col("image_key"), BASE_URL).alias("image_url"))


# joins


@query(
    "join_order_star",
    """SELECT o.id AS order_id, u.email AS user_email, s.name AS sale_name, p.name AS product_name, o.status,
              o.total_amount, i.quantity, i.unit_price
       FROM d_orders o JOIN d_users u ON u.id = o.user_id JOIN d_sales s ON s.id = o.sale_id
       JOIN d_order_items i ON i.order_id = o.id JOIN d_products p ON p.id = i.product_id""",
)
def join_order_star(v):
    return R.join_order_star(v.orders, v.users, v.sales, v.order_items, v.products).select(
        "order_id", "user_email", "sale_name", "product_name", "status", "total_amount", "quantity", "unit_price"
    )


@query(
    "join_sale_products_outer",
    """SELECT s.id AS sale_id, s.name AS sale_name, sp.id AS sale_product_id, p.name AS product_name
       FROM d_sales s LEFT JOIN d_sale_products sp ON sp.sale_id = s.id LEFT JOIN d_products p
       ON p.id = sp.product_id""",
)
def join_sale_products_outer(v):
    return R.join_sale_products_outer(v.sales, v.sale_products, v.products).select(
        "sale_id", "sale_name", "sale_product_id", "product_name"
    )


_LINES = """FROM d_sale_products sp LEFT JOIN (d_order_items i JOIN d_orders o ON o.id = i.order_id)
            ON i.product_id = sp.product_id AND o.sale_id = sp.sale_id"""


@query(
    "join_items_orders_in_sale",
    f"""SELECT sp.id AS sale_product_id, count(o.id) FILTER (o.status = 'CONFIRMED') AS confirmed_orders,
              count(o.id) FILTER (o.status = 'PENDING') AS pending_orders,
              count(o.id) FILTER (o.status = 'FAILED') AS failed_orders {_LINES} GROUP BY sp.id""",
)
def join_items_orders_in_sale(v):
    return R.join_items_orders_in_sale(v.sale_products, v.orders, v.order_items).select(
        "sale_product_id", "confirmed_orders", "pending_orders", "failed_orders"
    )


@query(
    "join_order_line_to_sale_product",
    """SELECT o.id AS order_id, i.product_id, i.quantity, sp.id AS sale_product_id
       FROM d_orders o JOIN d_order_items i ON i.order_id = o.id
       JOIN d_sale_products sp ON sp.product_id = i.product_id AND sp.sale_id = o.sale_id""",
)
def join_order_line_to_sale_product(v):
    return R.join_order_line_to_sale_product(v.orders, v.order_items, v.sale_products).select(
        "order_id", "product_id", "quantity", "sale_product_id"
    )


@query(
    "lookup_counters",
    """SELECT sp.id AS sale_product_id, sp.total_qty, c.live_qty, c.live_qty IS NOT NULL AS has_counter,
              coalesce(c.live_qty, 0) AS live_or_zero, coalesce(c.live_qty, sp.total_qty) AS live_or_total
       FROM d_sale_products sp LEFT JOIN d_live_counters c ON c.sale_product_id = sp.id""",
)
def lookup_counters(v):
    return R.lookup_counters(v.sale_products, v.live_counters).drop("sale_id", "product_id")


_RETRIES = """SELECT o.id AS order_id, o.user_id, o.sale_id, i.product_id
              FROM d_orders o JOIN d_order_items i ON i.order_id = o.id"""


def _retries(v):
    """Every order line asks again for its product."""
    heads = v.orders.select(F.col("id").alias("order_id"), "user_id", "sale_id", "status")
    return v.order_items.select("order_id", "product_id").join(heads, "order_id")


@query(
    "semi_prior_purchase",
    """SELECT r.*, EXISTS (SELECT 1 FROM d_orders o JOIN d_order_items i ON i.order_id = o.id
                           WHERE o.user_id = r.user_id AND o.sale_id = r.sale_id AND i.product_id = r.product_id
                             AND o.status IN ('PENDING', 'CONFIRMED')) AS blocked
       FROM x_retries r""",
    {"x_retries": _RETRIES},
)
def semi_prior_purchase(v):
    return R.semi_prior_purchase(_retries(v).drop("status"), v.orders, v.order_items)


@query(
    "anti_unknown_reference",
    """SELECT * FROM (SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM d_orders o WHERE o.id = r.order_id)
                                      THEN 'UNKNOWN_ORDER'
           WHEN NOT EXISTS (SELECT 1 FROM d_sales s WHERE s.id = r.sale_id) THEN 'UNKNOWN_SALE'
           WHEN NOT EXISTS (SELECT 1 FROM d_products p WHERE p.id = r.product_id) THEN 'UNKNOWN_PRODUCT'
           WHEN NOT EXISTS (SELECT 1 FROM d_sale_products sp WHERE sp.sale_id = r.sale_id
                            AND sp.product_id = r.product_id) THEN 'UNKNOWN_SALE_PRODUCT' END AS reason
       FROM x_odd r) WHERE reason IS NOT NULL""",
    {
        "x_retries": _RETRIES,
        "x_odd": """SELECT CASE WHEN order_id % 13 = 0 THEN -1 - order_id ELSE order_id END AS order_id,
                  CASE WHEN order_id % 11 = 0 THEN sale_id + 100000
                       WHEN order_id % 5 = 0 THEN 199501 ELSE sale_id END AS sale_id,
                  CASE WHEN order_id % 7 = 0 THEN product_id + 1000000000 ELSE product_id END AS product_id
                  FROM x_retries""",
    },
)
def anti_unknown_reference(v):
    o, s = F.col("order_id"), F.col("sale_id")
    odd = _retries(v).select(
        F.when(o % 13 == 0, -1 - o).otherwise(o).alias("order_id"),
        F.when(o % 11 == 0, s + 100000).when(o % 5 == 0, F.lit(199501)).otherwise(s).cast("bigint").alias("sale_id"),
        F.when(o % 7 == 0, F.col("product_id") + 1000000000).otherwise(F.col("product_id")).alias("product_id"),
    )
    return R.anti_unknown_reference(odd, v.sales, v.products, v.orders, v.sale_products)


# aggregates


@query(
    "order_status_counts",
    """SELECT coalesce(l.status, f.status) AS status, coalesce(f.n, 0) AS n
       FROM (VALUES ('PENDING'), ('CONFIRMED'), ('FAILED')) l(status)
       FULL JOIN (SELECT status, count(*) AS n FROM d_orders GROUP BY 1) f ON f.status = l.status""",
)
def order_status_counts(v):
    return R.order_status_counts(v.orders)


@query(
    "sale_status_counts",
    """SELECT coalesce(l.status, f.status) AS status, coalesce(f.n, 0) AS n
       FROM (VALUES ('SCHEDULED'), ('ACTIVE'), ('ENDED')) l(status)
       FULL JOIN (SELECT status, count(*) AS n FROM d_sales GROUP BY 1) f ON f.status = l.status""",
)
def sale_status_counts(v):
    return R.sale_status_counts(v.sales)


@query(
    "dashboard_stats",
    """SELECT (SELECT count(*) FROM d_users WHERE role = 'user') AS total_users,
              (SELECT CAST(coalesce(sum(total_amount), 0) AS DECIMAL(20,2)) FROM d_orders
               WHERE status = 'CONFIRMED') AS total_revenue,
              (SELECT count(*) FROM d_orders WHERE status = 'PENDING') AS pending_orders,
              (SELECT count(*) FROM d_orders WHERE status = 'CONFIRMED') AS confirmed_orders,
              (SELECT count(*) FROM d_orders WHERE status = 'FAILED') AS failed_orders,
              (SELECT count(*) FROM d_sales WHERE status = 'SCHEDULED') AS scheduled_sales,
              (SELECT count(*) FROM d_sales WHERE status = 'ACTIVE') AS active_sales,
              (SELECT count(*) FROM d_sales WHERE status = 'ENDED') AS ended_sales,
              (SELECT count(*) FROM d_orders WHERE status IN ('PENDING', 'CONFIRMED', 'FAILED')) AS total_orders""",
)
def dashboard_stats(v):
    return R.dashboard_stats(v.users, v.orders, v.sales)


@query("user_spend", _SPEND)
def user_spend(v):
    return R.user_spend(v.users, v.orders)


_MONITOR = f"""SELECT sp.id AS sale_product_id, sp.sale_id, p.name AS product_name, sp.total_qty, sp.reserved_qty,
       sp.sale_price, count(o.id) FILTER (o.status = 'CONFIRMED') AS confirmed_orders,
       count(o.id) FILTER (o.status = 'PENDING') AS pending_orders,
       count(o.id) FILTER (o.status = 'FAILED') AS failed_orders,
       CAST(coalesce(sum(o.total_amount) FILTER (o.status = 'CONFIRMED'), 0) AS DECIMAL(20,2)) AS revenue
   {_LINES} JOIN d_products p ON p.id = sp.product_id GROUP BY ALL"""
_PCT = """CASE WHEN total_qty <> 0 THEN CAST(floor(CAST(total_qty - coalesce(live_qty, total_qty) AS DOUBLE)
          / CAST(total_qty AS DOUBLE) * 100 + 0.5) AS BIGINT) END"""


def _monitor(v):
    return R.sale_monitor(v.sale_products, v.products, v.orders, v.order_items)


@query("sale_monitor", _MONITOR)
def sale_monitor(v):
    return _monitor(v)


@query(
    "sale_monitor_live",
    f"""SELECT m.*, c.live_qty AS live_inventory, {_PCT} AS sold_pct
        FROM x_monitor m LEFT JOIN d_live_counters c ON c.sale_product_id = m.sale_product_id""",
    {"x_monitor": _MONITOR},
)
def sale_monitor_live(v):
    return R.sale_monitor_live(_monitor(v), v.live_counters)


@query(
    "sale_monitor_totals",
    """SELECT sale_id, CAST(sum(revenue) AS DECIMAL(30,2)) AS total_revenue,
              CAST(sum(confirmed_orders) AS BIGINT) AS total_sold FROM x_monitor GROUP BY 1""",
    {"x_monitor": _MONITOR},
)
def sale_monitor_totals(v):
    return R.sale_monitor_totals(_monitor(v))


@query(
    "sale_card_totals",
    """SELECT s.id AS sale_id, s.name AS sale_name, count(sp.id) AS product_count,
              CAST(coalesce(sum(sp.total_qty), 0) AS BIGINT) AS total_items
       FROM d_sales s LEFT JOIN d_sale_products sp ON sp.sale_id = s.id GROUP BY ALL""",
)
def sale_card_totals(v):
    return R.sale_card_totals(v.sales, v.sale_products)


@query(
    "active_order_counts",
    f"""SELECT sp.id AS sale_product_id, count(o.id) FILTER (o.status IN ('PENDING', 'CONFIRMED')) AS active_orders
        {_LINES} GROUP BY sp.id""",
)
def active_order_counts(v):
    return R.active_order_counts(v.sale_products, v.orders, v.order_items).select("sale_product_id", "active_orders")


@query(
    "nested_order_items",
    f"""SELECT id, status, total_amount, CAST((n - 1) // {ORDER_NEST} AS INTEGER) AS part,
              string_agg(item, '|' ORDER BY n) AS items
       FROM (SELECT o.id, o.status, o.total_amount, concat_ws(',', i.product_id, i.quantity, i.unit_price) AS item,
                    row_number() OVER (PARTITION BY o.id ORDER BY i.product_id, i.quantity, i.unit_price) AS n
             FROM d_orders o JOIN d_order_items i ON i.order_id = o.id) GROUP BY ALL""",
)
def nested_order_items(v):
    docs = R.nested_order_items(v.orders, v.order_items, max_items=ORDER_NEST)
    return _flat(docs, "items", ["product_id", "quantity", "unit_price"]).select(
        "id", "status", "total_amount", "part", "items"
    )


@query(
    "nested_sale_products",
    _SALE_DOCS.format(chosen="SELECT * FROM d_sales", position="").replace(
        _SALE_ITEM, "concat_ws(',', sp.id, sp.product_id, sp.sale_price, sp.total_qty, sp.reserved_qty)"
    ),
)
def nested_sale_products(v):
    v.store_allocations()
    docs = R.nested_sale_products(v.sales, v.sale_products, max_items=NEST)
    return _flat(docs, "products", ["sale_product_id", "product_id", "sale_price", "total_qty", "reserved_qty"])


@query(
    "count_distinct_orders",
    """SELECT count(DISTINCT o.id) AS total FROM d_orders o JOIN d_users u ON u.id = o.user_id
       WHERE o.status = 'CONFIRMED'""",
)
def count_distinct_orders(v):
    return R.count_distinct_orders(v.orders, v.users, L.status_is("confirmed"))


@query("count_sketched_orders")
def count_sketched_orders(v):
    """An estimate, hence without SQL: sketches of the older days are stored, those of the others merged into them."""
    border = ts("1996-01-01 00:00:00")
    old = store(K.order_sketches(v.orders.filter(F.col("created_at") < border), v.users), "order-sketches")
    new = K.order_sketches(v.orders.filter(F.col("created_at") >= border), v.users)
    return K.count_from_sketches(K.merge_sketches(old, new), L.status_is("confirmed"))


# display figures


@query(
    "time_remaining",
    f"""SELECT sale_id, status, ms // 3600000 AS hours, ms // 60000 % 60 AS minutes, ms // 1000 % 60 AS seconds,
              ms <= 0 AS expired,
              CASE WHEN status <> 'ACTIVE' THEN status WHEN to_end <= 0 THEN 'Ended'
                   ELSE CASE WHEN ms // 3600000 < 10 THEN '0' ELSE '' END || (ms // 3600000) || ':'
                        || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':'
                        || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') END AS clock,
              CASE WHEN ms <= 0 THEN NULL WHEN status = 'SCHEDULED' THEN 'upcoming'
                   WHEN status = 'ACTIVE' AND ms < 600000 THEN 'urgent' ELSE 'normal' END AS urgency
        FROM (SELECT id AS sale_id, status,
                greatest(0, (epoch_us(CASE WHEN status = 'SCHEDULED' THEN start_time ELSE end_time END)
                             - epoch_us({SQL_AS_OF})) // 1000) AS ms,
                (epoch_us(end_time) - epoch_us({SQL_AS_OF})) // 1000 AS to_end FROM d_sales)""",
)
def time_remaining(v):
    return R.time_remaining(v.sales, ts(SALES_AS_OF))


@query(
    "stock_tiers",
    f"""SELECT sale_product_id, available,
              coalesce(least(greatest(CAST(available AS DOUBLE) / CAST(nullif(total_qty, 0) AS DOUBLE) * 100, 0.0),
                             100.0) < 20, false) AS card_low,
              CAST(available AS DOUBLE) <= CAST(total_qty AS DOUBLE) * CAST(0.2 AS DOUBLE) AS monitor_low,
              CASE WHEN pct > 80 THEN 'high' WHEN pct > 50 THEN 'medium' ELSE 'low' END AS sold_band,
              available <= 0 AS sold_out, status = 'ACTIVE' AND available > 0 AS buyable
        FROM (SELECT sp.id AS sale_product_id, sp.total_qty, coalesce(c.live_qty, sp.total_qty) AS available,
                     s.status, {_PCT} AS pct
              FROM d_sale_products sp JOIN d_sales s ON s.id = sp.sale_id
              LEFT JOIN d_live_counters c ON c.sale_product_id = sp.id)""",
)
def stock_tiers(v):
    statuses = v.sales.select(F.col("id").alias("sale_id"), "status")
    lines = v.sale_products.join(statuses, "sale_id").withColumnRenamed("id", "sale_product_id")
    return R.stock_tiers(C.with_live_qty(lines, v.live_counters))


_INR = """reverse(regexp_replace(regexp_replace(reverse(CAST({n} // 1000 AS VARCHAR)), '(..)', '\\1,', 'g'), ',$', ''))"""


@query(
    "inr_format",
    f"""SELECT id, CASE WHEN whole >= 1000 THEN {_INR.format(n="whole")} || ','
                        || lpad(CAST(whole % 1000 AS VARCHAR), 3, '0') ELSE CAST(whole AS VARCHAR) END
              || CASE cents WHEN 0 THEN '' ELSE '.' || rtrim(lpad(CAST(cents AS VARCHAR), 2, '0'), '0') END AS amount
        FROM (SELECT id, CAST(floor(total_amount) AS BIGINT) AS whole,
                     CAST(total_amount * 100 AS BIGINT) % 100 AS cents FROM d_orders)""",
)
def inr_format(v):
    return v.orders.select("id", S.indian_grouping(F.col("total_amount")).alias("amount"))


@query(
    "scalar_texts",
    """SELECT o.id, strftime(o.created_at, '%-d %b %Y, %-I:%M ') || lower(strftime(o.created_at, '%p')) AS placed,
              strftime(o.created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso,
              upper(split_part(o.idempotency_key, '-', 1)) AS code, split_part(u.full_name, ' ', 1) AS first_name,
              CAST(o.total_amount * 1.5 AS DECIMAL(10,2)) AS scaled,
              CAST(floor(CAST(o.id AS DOUBLE) / 2 - 10 + 0.5) AS BIGINT) AS rounded
       FROM d_orders o JOIN d_users u ON u.id = o.user_id""",
)
def scalar_texts(v):
    people = v.users.select(F.col("id").alias("user_id"), "full_name")
    return v.orders.join(people, "user_id").select(
        "id",
        S.medium_datetime(F.col("created_at")).alias("placed"),
        S.iso_text(F.col("created_at")).alias("iso"),
        S.short_code(F.col("idempotency_key")).alias("code"),
        S.first_name(F.col("full_name")).alias("first_name"),
        S.to_money(F.col("total_amount") * F.expr("1.5BD")).alias("scaled"),
        S.round_half_up(F.col("id").cast("double") / 2 - 10).alias("rounded"),
    )


_MIXED = """CASE p_partkey % 8 WHEN 0 THEN '  ' || p_partkey || 'kg' WHEN 1 THEN '-' || p_retailprice_text
              WHEN 2 THEN 'abc' WHEN 3 THEN p_retailprice_text || 'e1x' WHEN 4 THEN '' WHEN 5 THEN '.5' || p_name
              WHEN 6 THEN '+' || p_partkey || ' ' ELSE chr(160) || p_retailprice_text || chr(9) END"""


@query(
    "number_prefixes",
    rf"""SELECT id, TRY_CAST(regexp_extract(txt, '^[\s\x{{A0}}]*([+-]?\d+)', 1) AS BIGINT) AS as_int,
               TRY_CAST(regexp_extract(txt, '^[\s\x{{A0}}]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) AS DOUBLE)
                 AS as_float,
               nullif(regexp_replace(txt, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'), '') AS trimmed
        FROM (SELECT p_partkey AS id, {_MIXED} AS txt
              FROM (SELECT *, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) AS p_retailprice_text FROM part))""",
)
def number_prefixes(v):
    texts = (
        v.raw("part")
        .withColumn("p_retailprice_text", F.col("p_retailprice").cast("decimal(10,2)").cast("string"))
        .select(F.col("p_partkey").alias("id"), F.expr(_MIXED).alias("txt"))
    )
    return texts.select(
        "id",
        S.parse_int(F.col("txt")).alias("as_int"),
        S.parse_float(F.col("txt")).alias("as_float"),
        S.blank_to_null(F.col("txt")).alias("trimmed"),
    )
