"""Joins, counts and sums behind the dashboards and the sale monitor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.functions.scalars import millis_between, round_half_up
from stockyard.operators.listings import newest_first, order_lines, page, where_all
from stockyard.operators.nesting import MAX_ITEMS, headed, nest
from stockyard.operators.sizing import left_join_many
from stockyard.schemas import LIVE_ORDER_STATUSES, ORDER_STATUSES, SALE_STATUSES
from stockyard.session import pin


def _rename(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


# joins


def join_order_star(orders, users, sales, order_items, products) -> DataFrame:
    """orders x users x sales x order_items x products, one row per order line."""
    lines = order_lines(order_items, products)
    return (
        orders.withColumnRenamed("id", "order_id")
        .join(_rename(users, user_id="id", user_email="email", user_name="full_name"), "user_id")
        .join(_rename(sales, sale_id="id", sale_name="name"), "sale_id")
        .join(lines, "order_id")
    )


def join_sale_products_outer(sales, sale_products, products) -> DataFrame:
    """sales with their sale products and product names; every sale is kept."""
    named = _rename(products, product_id="id", product_name="name")
    heads = _rename(sales, sale_id="id", sale_name="name", status="status")
    lines = sale_products.withColumnRenamed("id", "sale_product_id")
    return left_join_many(heads, lines, ["sale_id"]).join(named, "product_id", "left")


def order_lines_by_sale_product(orders: DataFrame, order_items: DataFrame, *aggregates: Column) -> DataFrame:
    """Order lines aggregated per (sale_id, product_id).

    The source joins sale products to every line of the product in any sale and
    blanks the foreign ones. Aggregating lines on both keys first gives the same
    counts and sums without those rows.
    """
    heads = orders.select(F.col("id").alias("order_id"), "sale_id", "status", "total_amount")
    return order_items.select("order_id", "product_id").join(heads, "order_id").groupBy(
        "sale_id", "product_id"
    ).agg(*aggregates)


def _line_counts() -> list[Column]:
    return [
        F.count_if(F.col("status") == "CONFIRMED").alias("confirmed_orders"),
        F.count_if(F.col("status") == "PENDING").alias("pending_orders"),
        F.count_if(F.col("status") == "FAILED").alias("failed_orders"),
    ]


def join_items_orders_in_sale(sale_products, orders, order_items) -> DataFrame:
    """Per sale product: order lines of its own sale by status, zero when none."""
    counts = order_lines_by_sale_product(orders, order_items, *_line_counts())
    zero = ["confirmed_orders", "pending_orders", "failed_orders"]
    return (
        sale_products.join(counts, ["sale_id", "product_id"], "left")
        .withColumnRenamed("id", "sale_product_id")
        .fillna(0, zero)
    )


def join_order_line_to_sale_product(orders, order_items, sale_products) -> DataFrame:
    """Order lines with the sale product of the order's own sale."""
    heads = orders.select(
        F.col("id").alias("order_id"), "user_id", "sale_id", "status", "total_amount", "created_at"
    )
    keys = sale_products.select(F.col("id").alias("sale_product_id"), "sale_id", "product_id")
    return (
        order_items.select(F.col("id").alias("item_id"), "order_id", "product_id", "quantity")
        .join(heads, "order_id")
        .join(keys, ["sale_id", "product_id"])
    )


def lookup_counters(sale_products: DataFrame, counters: DataFrame) -> DataFrame:
    """Sale products with their counter under each policy for a missing one."""
    return sale_products.withColumnRenamed("id", "sale_product_id").join(
        counters, "sale_product_id", "left"
    ).select(
        "sale_product_id",
        "sale_id",
        "product_id",
        "total_qty",
        "live_qty",
        F.col("live_qty").isNotNull().alias("has_counter"),
        F.coalesce("live_qty", F.lit(0)).alias("live_or_zero"),
        F.coalesce("live_qty", "total_qty").alias("live_or_total"),
    )


def live_purchases(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Distinct (user_id, sale_id, product_id) with a PENDING or CONFIRMED order."""
    held = orders.filter(F.col("status").isin(*LIVE_ORDER_STATUSES)).select(
        F.col("id").alias("order_id"), "user_id", "sale_id"
    )
    return order_items.select("order_id", "product_id").join(held, "order_id").select(
        "user_id", "sale_id", "product_id"
    ).distinct()


def semi_prior_purchase(requests: DataFrame, orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Requests flagged `blocked` where the user already holds the product in the sale."""
    held = live_purchases(orders, order_items).withColumn("_held", F.lit(True))
    return requests.join(held, ["user_id", "sale_id", "product_id"], "left").withColumn(
        "blocked", F.coalesce("_held", F.lit(False))
    ).drop("_held")


def anti_unknown_reference(
    requests: DataFrame, sales: DataFrame, products: DataFrame, orders: DataFrame, sale_products: DataFrame
) -> DataFrame:
    """Requests that name a missing order, sale, product or sale product, with the first such reason."""

    def known(df: DataFrame, flag: str, **names: str) -> DataFrame:
        return _rename(df, **names).withColumn(flag, F.lit(True))

    checked = (
        requests.join(known(orders, "_o", order_id="id"), "order_id", "left")
        .join(known(sales, "_s", sale_id="id"), "sale_id", "left")
        .join(known(products, "_p", product_id="id"), "product_id", "left")
        .join(
            known(sale_products, "_sp", sale_id="sale_id", product_id="product_id"), ["sale_id", "product_id"], "left"
        )
    )
    reason = (
        F.when(F.col("_o").isNull(), "UNKNOWN_ORDER")
        .when(F.col("_s").isNull(), "UNKNOWN_SALE")
        .when(F.col("_p").isNull(), "UNKNOWN_PRODUCT")
        .when(F.col("_sp").isNull(), "UNKNOWN_SALE_PRODUCT")
    )
    return checked.withColumn("reason", reason).drop("_o", "_s", "_p", "_sp").filter("reason IS NOT NULL")


# aggregates


def status_counts(df: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Rows per status; listed statuses without rows count 0, unlisted ones are kept."""
    listed = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, statuses))).alias("status"))
    found = df.groupBy("status").agg(F.count("*").alias("n"))
    return listed.join(found, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def order_status_counts(orders: DataFrame) -> DataFrame:
    return status_counts(orders, ORDER_STATUSES)


def sale_status_counts(sales: DataFrame) -> DataFrame:
    return status_counts(sales, SALE_STATUSES)


def dashboard_stats(users: DataFrame, orders: DataFrame, sales: DataFrame) -> DataFrame:
    """One row of counts and revenue; one scan per table, added up without a join."""
    status = F.col("status")
    figures = {
        "total_users": (users, F.count_if(F.col("role") == "user")),
        "total_revenue": (orders, F.sum(F.when(status == "CONFIRMED", F.col("total_amount")))),
        **{f"{s.lower()}_orders": (orders, F.count_if(status == s)) for s in ORDER_STATUSES},
        **{f"{s.lower()}_sales": (sales, F.count_if(status == s)) for s in SALE_STATUSES},
    }
    parts = None
    for table in (users, orders, sales):
        own = {k: agg for k, (t, agg) in figures.items() if t is table}
        row = table.agg(*[agg.alias(k) for k, agg in own.items()])
        parts = row if parts is None else parts.unionByName(row, allowMissingColumns=True)
    total = parts.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in figures])
    return total.select(
        *[F.col(k).cast("decimal(20,2)" if k == "total_revenue" else "bigint").alias(k) for k in figures],
        (F.col("pending_orders") + F.col("confirmed_orders") + F.col("failed_orders")).alias("total_orders"),
    )


def user_spend(users: DataFrame, orders: DataFrame) -> DataFrame:
    """Per user: orders of any status, and money of the CONFIRMED ones."""
    spent = orders.groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("order_count"),
        F.sum(F.when(F.col("status") == "CONFIRMED", F.col("total_amount"))).alias("total_spent"),
    )
    return users.join(spent, "id", "left").select(
        *users.columns,
        F.coalesce("order_count", F.lit(0)).alias("order_count"),
        F.coalesce("total_spent", F.lit(0)).cast("decimal(20,2)").alias("total_spent"),
    )


def list_users_spend(users: DataFrame, orders: DataFrame, page_no: int = 1, limit: int = 20) -> DataFrame:
    """A page of users, newest first, with their orders and what they spent; limits are not clamped here.

    The page is cut first, so only its users' orders are read into the sums.
    """
    chosen = page(users, newest_first(), (page_no - 1) * limit, limit, "position")
    chosen = pin(chosen)  # read by the filter of the orders and by the join
    own = orders.join(F.broadcast(chosen.select(F.col("id").alias("user_id"))), "user_id", "left_semi")
    return user_spend(chosen, own).orderBy("position")


def sale_monitor(sale_products, products, orders, order_items) -> DataFrame:
    """Per sale product: lines by status and confirmed revenue.

    Counts are per order line, and revenue adds the whole order total per line,
    so orders with several items count more than once, as in the source.
    """
    counts = order_lines_by_sale_product(
        orders,
        order_items,
        *_line_counts(),
        F.sum(F.when(F.col("status") == "CONFIRMED", F.col("total_amount"))).alias("revenue"),
    )
    return monitor_of_counts(sale_products, products, counts)


def monitor_of_counts(sale_products: DataFrame, products: DataFrame, counts: DataFrame) -> DataFrame:
    """The monitor's rows for line counts and revenue per sale and product."""
    return (
        sale_products.join(counts, ["sale_id", "product_id"], "left")
        .join(_rename(products, product_id="id", product_name="name"), "product_id")
        .select(
            F.col("id").alias("sale_product_id"),
            "sale_id",
            "product_name",
            "total_qty",
            "reserved_qty",
            "sale_price",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("confirmed_orders", "pending_orders", "failed_orders")],
            F.coalesce("revenue", F.lit(0)).cast("decimal(20,2)").alias("revenue"),
        )
    )


def sold_pct(total: Column, live: Column) -> Column:
    """Share sold in whole percent; NULL for a total of 0. No counter means nothing sold."""
    sold = (total - F.coalesce(live, total)).cast("double")
    return F.when(total != 0, round_half_up(sold / total.cast("double") * 100))


def sale_monitor_live(monitor: DataFrame, counters: DataFrame) -> DataFrame:
    return monitor.join(counters, "sale_product_id", "left").select(
        *monitor.columns,
        F.col("live_qty").alias("live_inventory"),
        sold_pct(F.col("total_qty"), F.col("live_qty")).alias("sold_pct"),
    )


def sale_monitor_totals(monitor: DataFrame) -> DataFrame:
    """Per sale: revenue and confirmed lines."""
    return monitor.groupBy("sale_id").agg(
        F.sum("revenue").cast("decimal(30,2)").alias("total_revenue"), F.sum("confirmed_orders").alias("total_sold")
    )


def sale_card_totals(sales: DataFrame, sale_products: DataFrame) -> DataFrame:
    totals = sale_products.groupBy("sale_id").agg(
        F.count("*").alias("product_count"), F.sum("total_qty").alias("total_items")
    )
    return _rename(sales, sale_id="id", sale_name="name").join(totals, "sale_id", "left").fillna(
        0, ["product_count", "total_items"]
    )


def active_order_counts(sale_products, orders, order_items) -> DataFrame:
    """Per sale product: PENDING and CONFIRMED order lines."""
    live = orders.filter(F.col("status").isin(*LIVE_ORDER_STATUSES))
    counts = order_lines_by_sale_product(live, order_items, F.count("*").alias("active_orders"))
    return (
        sale_products.join(counts, ["sale_id", "product_id"], "left")
        .withColumnRenamed("id", "sale_product_id")
        .fillna(0, ["active_orders"])
    )


def nested_order_items(orders: DataFrame, order_items: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Order headers with their items, in rows of at most `max_items`; orders without items are left out."""
    nested = nest(order_items, ["order_id"], ["product_id", "quantity", "unit_price"], "items", max_items)
    return orders.join(nested.withColumnRenamed("order_id", "id"), "id")


def nested_sale_products(sales: DataFrame, sale_products: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Sales with their sale products; NULL where there are none."""
    nested = nest(
        sale_products.withColumnRenamed("id", "sale_product_id"),
        ["sale_id"],
        ["sale_product_id", "product_id", "sale_price", "total_qty", "reserved_qty"],
        "products",
        max_items,
    )
    own = sale_products.select(F.col("sale_id").alias("id"))
    return headed(sales, nested.withColumnRenamed("sale_id", "id"), "id", own)


def count_distinct_orders(
    orders: DataFrame, users: DataFrame, *predicates: Column | None, approximate: bool = False
) -> DataFrame:
    """Orders of known users that meet the supplied predicates."""
    chosen = where_all(orders, *predicates).join(_rename(users, user_id="id"), "user_id", "left_semi")
    if approximate:
        return chosen.agg(F.approx_count_distinct("id").alias("total"))
    return chosen.agg(F.count_distinct("id").alias("total"))


# derived display figures


def time_remaining(sales: DataFrame, as_of: Column) -> DataFrame:
    """Countdown to the end of an ACTIVE sale or the start of a SCHEDULED one."""
    upcoming = F.col("status") == "SCHEDULED"
    target = F.when(upcoming, F.col("start_time")).otherwise(F.col("end_time"))
    left = F.greatest(millis_between(target, as_of), F.lit(0))
    timed = (
        sales.withColumn("_ms", left)
        .withColumn("hours", F.expr("_ms div 3600000"))
        .withColumn("minutes", F.expr("(_ms div 60000) % 60"))
        .withColumn("seconds", F.expr("(_ms div 1000) % 60"))
        .withColumn("expired", F.col("_ms") <= 0)
    )

    def two(c):
        text = F.col(c).cast("string")
        return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)

    clock = F.concat_ws(":", two("hours"), two("minutes"), two("seconds"))
    ms_to_end = millis_between(F.col("end_time"), as_of)
    return timed.select(
        F.col("id").alias("sale_id"),
        "status",
        "hours",
        "minutes",
        "seconds",
        "expired",
        F.when(F.col("status") != "ACTIVE", F.col("status"))
        .when(ms_to_end <= 0, "Ended")
        .otherwise(clock)
        .alias("clock"),
        F.when(F.col("expired"), F.lit(None).cast("string"))
        .when(upcoming, "upcoming")
        .when((F.col("status") == "ACTIVE") & (F.col("hours") == 0) & (F.col("minutes") < 10), "urgent")
        .otherwise("normal")
        .alias("urgency"),
    )


def stock_tiers(lines: DataFrame) -> DataFrame:
    """Stock bands per sale product; needs status, total_qty, live_qty.

    The card is low below 20 % and the monitor at or below 20 %, as in the source.
    """
    total = F.col("total_qty")
    available = F.coalesce("live_qty", "total_qty")
    share = F.when(
        total != 0, F.least(F.greatest(available.cast("double") / total.cast("double") * 100, F.lit(0.0)), F.lit(100.0))
    )
    pct = sold_pct(total, F.col("live_qty"))
    return lines.select(
        "sale_product_id",
        available.alias("available"),
        F.coalesce(share < 20, F.lit(False)).alias("card_low"),
        (available.cast("double") <= total.cast("double") * 0.2).alias("monitor_low"),
        F.when(pct > 80, "high").when(pct > 50, "medium").otherwise("low").alias("sold_band"),
        (available <= 0).alias("sold_out"),
        ((F.col("status") == "ACTIVE") & (available > 0)).alias("buyable"),
    )
