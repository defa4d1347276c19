"""Pages of products, sales, orders and users, and the filters they share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.functions.scalars import clamp_page, image_url
from stockyard.operators.blocks import range_blocks
from stockyard.operators.nesting import MAX_ITEMS, headed, nest
from stockyard.operators.sizing import left_join_many
from stockyard.session import pin, store

# Largest offset + limit that is answered by a top-k on the driver side.
TOP_K_ROWS = 50_000

SALE_PRODUCT_FIELDS = (
    "sale_product_id",
    "product_id",
    "product_name",
    "description",
    "image_key",
    "sale_price",
    "total_qty",
    "reserved_qty",
)


def where_all(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Keep rows that meet every predicate that was supplied."""
    given = [p for p in predicates if p is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def status_is(status: str | None, column: str = "status") -> Column | None:
    return F.col(column) == status.upper() if status else None


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int, position: str | None = None) -> DataFrame:
    """Rows offset .. offset+limit in `order` (end it with a unique column), in that order.

    `position` names a column for a row's place in the whole listing, from 1.
    Shallow pages are a top-k. A deep page would gather everything before it, so
    it is cut out of a range-partitioned sort by position instead.
    """
    if offset + limit <= TOP_K_ROWS:
        rows = df.orderBy(*order).offset(offset).limit(limit)
        if position is None:
            return rows
        place = F.row_number().over(Window.orderBy(*order)).cast("bigint") + offset  # one page of rows
        return rows.withColumn(position, place)
    blocked = range_blocks(df, [], list(order))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy("block")
        .agg(F.count("*").alias("_n"))
        .select("block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    at = F.col("_start") + F.col("pos")
    inside = blocked.join(F.broadcast(starts), "block").filter((at >= offset) & (at < offset + limit)).orderBy(at)
    return inside.select(*df.columns, *([(at + 1).alias(position)] if position else []))


def newest_first(time: str = "created_at", key: str = "id") -> list[Column]:
    return [F.desc(time), F.asc(key)]


def pagination_meta(df: DataFrame, page_no: int, limit: int) -> DataFrame:
    """One row: total, page, limit, total_pages."""
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(page_no).cast("bigint").alias("page"),
        F.lit(limit).cast("bigint").alias("limit"),
        F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("total_pages"),
    )


def list_active_products(products: DataFrame, base_url: str, page_no=1, limit=10) -> DataFrame:
    _, n, offset = clamp_page(page_no, limit)
    active = products.filter("is_active").select(
        "id", "name", "description", "base_price", "image_key", "is_active", "created_at"
    )
    rows = page(active, newest_first(), offset, n, "position")
    return rows.withColumn("image_url", image_url(F.col("image_key"), base_url))


def sale_lines(sale_products: DataFrame, products: DataFrame) -> DataFrame:
    """Sale products with the product columns a sale document shows."""
    named = products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "description", "image_key"
    )
    return sale_products.withColumnRenamed("id", "sale_product_id").join(named, "product_id", "left")


def list_sales_catalog(
    sales: DataFrame,
    sale_products: DataFrame,
    products: DataFrame,
    status: str | None = None,
    page_no=1,
    limit=10,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """A page of sales, latest start first, each with its products (NULL when none).

    A sale with more than `max_items` products is several rows, numbered by `part`;
    `position` is the sale's place in the listing. The page is cut before the joins, so only its sales are joined and nested.
    Its lines are stored, which tells the planner how few they are: the products
    are then filtered by a broadcast instead of shuffled.
    """
    _, n, offset = clamp_page(page_no, limit)
    chosen = pin(page(where_all(sales, status_is(status)), newest_first("start_time"), offset, n, "position"))
    lines = store(sale_products.join(chosen.select(F.col("id").alias("sale_id")), "sale_id", "left_semi"))
    near = products.join(lines.select(F.col("product_id").alias("id")), "id", "left_semi")
    nested = nest(sale_lines(lines, near), ["sale_id"], SALE_PRODUCT_FIELDS, "products", max_items, lines)
    columns = ["position", "id", "name", "start_time", "end_time", "status", "created_at", "part", "products"]
    own = lines.withColumn("id", F.col("sale_id"))
    listed = headed(F.broadcast(chosen), nested.withColumnRenamed("sale_id", "id"), "id", own).select(*columns)
    return listed.orderBy("position", "part")


def sale_detail_rows(
    sales: DataFrame, sale_products: DataFrame, products: DataFrame, counters: DataFrame
) -> DataFrame:
    """One row per sale product (one empty row for a sale without any), with live stock.

    available_qty is the counter, 0 where it is missing, and NULL unless the sale is ACTIVE.
    """
    counted = sale_products.join(counters.withColumnRenamed("sale_product_id", "id"), "id", "left")  # while rows are narrow
    lines = sale_lines(counted, products)
    lines = lines.select("sale_product_id", *[c for c in lines.columns if c != "sale_product_id"])
    joined = left_join_many(sales.withColumnRenamed("id", "sale_id"), lines, ["sale_id"])
    live = F.when(
        (F.col("status") == "ACTIVE") & F.col("sale_product_id").isNotNull(),
        F.coalesce("live_qty", F.lit(0)),
    )
    return joined.withColumn("available_qty", live).drop("live_qty")


def sale_detail_live(
    sales: DataFrame,
    sale_products: DataFrame,
    products: DataFrame,
    counters: DataFrame,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """The chosen sales as documents; filter `sales` to choose."""
    chosen = sale_products.join(sales.select(F.col("id").alias("sale_id")), "sale_id", "left_semi")
    rows = sale_detail_rows(sales, chosen, products, counters).filter("sale_product_id IS NOT NULL")
    nested = nest(rows, ["sale_id"], [*SALE_PRODUCT_FIELDS, "available_qty"], "products", max_items, chosen)
    own = chosen.filter("id IS NOT NULL").select(F.col("sale_id").alias("id"))
    return headed(sales, nested.withColumnRenamed("sale_id", "id"), "id", own)


def order_lines(order_items: DataFrame, products: DataFrame) -> DataFrame:
    named = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return order_items.join(named, "product_id")


def _with_items(
    chosen: DataFrame, order_items: DataFrame, products: DataFrame, fields, max_items, one_page: bool
) -> DataFrame:
    """Orders with their items. The items of one page are stored, so the planner knows how few they are."""
    lines = order_items.drop("id").join(chosen.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    if one_page:
        lines = store(lines)
    nested = nest(order_lines(lines, products), ["order_id"], fields, "items", max_items, lines)
    return chosen.join(nested.withColumnRenamed("order_id", "id"), "id")


def _listed(orders: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Orders with at least one item of a known product; the lists leave out the others."""
    known = order_items.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    return orders.join(known.select(F.col("order_id").alias("id")), "id", "left_semi")


def _page_of_listed(
    orders: DataFrame, order_items: DataFrame, products: DataFrame, parents: Sequence[tuple], offset: int, limit: int
) -> DataFrame:
    """A page, newest first, of the orders that have all `parents` and a listed item.

    `parents` are (frame, key) pairs to join. Orders are in page order before
    the joins, so twice the rows needed are taken from the orders alone and only
    these are joined, as the broadcast side. When too many of them drop out, all
    orders are joined instead.
    """

    def joined(df: DataFrame, small: bool) -> DataFrame:
        for parent, key in parents:
            df = parent.join(F.broadcast(df) if small else df, key)
        return df

    needed = offset + limit
    taken = 2 * needed + 100
    if taken <= TOP_K_ROWS:
        first = pin(orders.orderBy(*newest_first()).limit(taken))
        ids = first.select(F.col("id").alias("order_id"))
        items = order_items.select("order_id", "product_id").join(F.broadcast(ids), "order_id", "left_semi")
        known = items.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
        whole = joined(first, True).join(
            known.select(F.col("order_id").alias("id")).distinct(), "id", "left_semi"
        )
        whole = pin(whole)
        if whole.count() >= needed or first.count() < taken:
            return page(whole, newest_first(), offset, limit, "position")
    return page(_listed(joined(orders, False), order_items, products), newest_first(), offset, limit, "position")


def list_user_orders(
    orders: DataFrame,
    sales: DataFrame,
    order_items: DataFrame,
    products: DataFrame,
    user_id=None,
    page_no=1,
    limit=10,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """A page of a user's orders, newest first, with sale name and items.

    Without `user_id` the same page of every user is returned, in no order of
    users. `position` is an order's place among its user's.
    """
    _, n, offset = clamp_page(page_no, limit)
    named = sales.select(F.col("id").alias("sale_id"), F.col("name").alias("sale_name"))
    columns = ["id", "user_id", "sale_id", "status", "total_amount", "created_at", "updated_at", "sale_name"]
    if user_id is not None:
        own = orders.filter(F.col("user_id") == user_id)
        chosen = _page_of_listed(own, order_items, products, [(named, "sale_id")], offset, n)
        chosen = chosen.select(*columns, "position")
    else:
        header = _listed(orders.join(named, "sale_id"), order_items, products).select(*columns)
        # rank <= literal lets Spark cut each group before it is shuffled
        rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*newest_first()))
        chosen = (
            header.withColumn("_rank", rank)
            .filter(F.col("_rank") <= offset + n)
            .filter(F.col("_rank") > offset)
            .withColumn("position", F.col("_rank").cast("bigint"))
            .drop("_rank")
        )
    pages = _with_items(
        chosen,
        order_items,
        products,
        ["product_id", "product_name", "quantity", "unit_price"],
        max_items,
        user_id is not None,
    )
    return pages if user_id is None else pages.orderBy("position", "part")


def order_detail(
    orders: DataFrame, sales: DataFrame, order_items: DataFrame, products: DataFrame, max_items: int = MAX_ITEMS
) -> DataFrame:
    """Orders with sale name, idempotency key and items; filter `orders` by id and owner to choose."""
    named = sales.select(F.col("id").alias("sale_id"), F.col("name").alias("sale_name"))
    fields = ["product_id", "product_name", "quantity", "unit_price"]
    nested = nest(order_lines(order_items, products), ["order_id"], fields, "items", max_items, order_items)
    return orders.join(named, "sale_id").join(nested.withColumnRenamed("order_id", "id"), "id")


def list_admin_orders(
    orders: DataFrame,
    users: DataFrame,
    sales: DataFrame,
    order_items: DataFrame,
    products: DataFrame,
    status: str | None = None,
    page_no: int = 1,
    limit: int = 20,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """A page of all orders with user, sale and items, newest first; limits are not clamped here."""
    people = users.select(
        F.col("id").alias("user_id"), F.col("email").alias("user_email"), F.col("full_name").alias("user_name")
    )
    named = sales.select(F.col("id").alias("sale_id"), F.col("name").alias("sale_name"))
    chosen = _page_of_listed(
        where_all(orders, status_is(status)),
        order_items,
        products,
        [(named, "sale_id"), (people, "user_id")],
        (page_no - 1) * limit,
        limit,
    )
    header = chosen.select(
        "id", "status", "total_amount", "created_at", "updated_at", "user_email", "user_name", "sale_name", "position"
    )
    fields = ["product_name", "quantity", "unit_price"]
    return _with_items(header, order_items, products, fields, max_items, True).orderBy("position", "part")
