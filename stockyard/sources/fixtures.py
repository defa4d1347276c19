"""Domain relations derived from the generated star-schema tables.

Each property is the Spark form of the view of the same name in
`stockyard.plans.sqlviews`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.session import store

SALES_AS_OF = "2001-06-15 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
# A sale product's id is sale_id * LINE_IDS + product_id; more than there are products at any scale.
LINE_IDS = 100_000_000_000


def ts(text: str):
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


class Fixtures:
    """Lazy domain views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@example.com")).alias("email"),
            F.col("c_name").alias("full_name"),
            F.when(F.col("c_nationkey") == 0, "admin").otherwise("user").alias("role"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            F.expr("TIMESTAMP_NTZ'1994-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 365 AS INT))").alias(
                "created_at"
            ),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.lit(None).cast("string").alias("description"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("base_price"),
            F.when(
                F.col("p_partkey") % 3 != 0,
                F.concat(F.lit("products/"), F.col("p_partkey").cast("string"), F.lit(".png")),
            ).alias("image_key"),
            (F.col("p_size") % 10 != 0).alias("is_active"),
            F.expr("TIMESTAMP_NTZ'1994-01-01 00:00:00' + make_dt_interval(cast(p_partkey % 365 AS INT))").alias(
                "created_at"
            ),
        )

    @cached_property
    def orders(self) -> DataFrame:
        sale = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            sale.alias("sale_id"),
            F.concat_ws("-", F.col("o_custkey").cast("string"), sale.cast("string")).alias("idempotency_key"),
            F.when(F.col("o_orderstatus") == "P", "PENDING")
            .when(F.col("o_orderstatus") == "F", "FAILED")
            .otherwise("CONFIRMED")
            .alias("status"),
            F.col("o_totalprice").cast("decimal(10,2)").alias("total_amount"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.concat_ws(
                "-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
            ).alias("id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("unit_price"),
        )

    @cached_property
    def sales(self) -> DataFrame:
        start = F.expr("try_make_timestamp_ntz(cast(sale_id div 100 AS INT), cast(sale_id % 100 AS INT), 1, 0, 0, 0)")
        as_of = ts(SALES_AS_OF)
        return (
            self.orders.select("sale_id")
            .distinct()
            .withColumn("start_time", start)
            .withColumn("end_time", F.expr("start_time + INTERVAL 3 MONTH"))
            .select(
                F.col("sale_id").alias("id"),
                F.concat(F.lit("Sale "), F.col("sale_id").cast("string")).alias("name"),
                "start_time",
                "end_time",
                F.when(F.col("end_time") <= as_of, "ENDED")
                .when(F.col("start_time") <= as_of, "ACTIVE")
                .otherwise("SCHEDULED")
                .alias("status"),
                F.col("start_time").alias("created_at"),
            )
        )

    @cached_property
    def _allocations(self) -> DataFrame:
        lines = self.order_items.join(
            self.orders.select(F.col("id").alias("order_id"), "sale_id", "status"), "order_id"
        )
        live = F.col("status") != "FAILED"
        per_product = lines.groupBy("sale_id", "product_id").agg(
            F.sum("quantity").alias("units"),
            F.coalesce(F.sum(F.when(live, F.col("quantity"))), F.lit(0)).alias("reserved"),
            F.count_if(live).alias("live_lines"),
        )
        priced = per_product.join(
            self.products.select(F.col("id").alias("product_id"), "base_price"), "product_id"
        )
        return priced.select(
            (F.col("sale_id") * LINE_IDS + F.col("product_id")).alias("id"),
            "sale_id",
            "product_id",
            (F.col("base_price") * F.expr("0.8BD")).cast("decimal(10,2)").alias("sale_price"),
            (F.col("units") + F.col("product_id") % 5).cast("int").alias("total_qty"),
            F.col("reserved").cast("int").alias("reserved_qty"),
            "live_lines",
        )

    def store_allocations(self) -> "Fixtures":
        """Derive the sale products and counters once, for queries that read them several times."""
        self._allocations = store(self._allocations, "allocations")
        return self

    @cached_property
    def sale_products(self) -> DataFrame:
        return self._allocations.drop("live_lines")

    @cached_property
    def live_counters(self) -> DataFrame:
        return self._allocations.filter("product_id % 7 != 0").select(
            F.col("id").alias("sale_product_id"),
            (F.col("total_qty") - F.col("live_lines") + (F.col("product_id") + F.col("sale_id")) % 3 - 1)
            .cast("int")
            .alias("live_qty"),
        )

    @cached_property
    def inventory(self) -> DataFrame:
        start = F.expr("try_make_timestamp_ntz(cast(sale_id div 100 AS INT), cast(sale_id % 100 AS INT), 1, 0, 0, 0)")
        return self.sale_products.select(
            "id", F.col("id").alias("sale_product_id"), F.col("total_qty").alias("available_qty"),
            start.alias("last_synced_at"),
        )

    @cached_property
    def outbox(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.when(kind == "purchase", "ORDER_CREATED")
            .when(kind == "signup", "PAYMENT_SUCCESS")
            .when(kind == "error", "PAYMENT_FAILED")
            .otherwise(F.upper(kind))
            .alias("event_type"),
            F.col("props").alias("payload"),
            (F.col("event_id") % 3 == 0).alias("published"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def _stock_log(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            "user_id",
            "ts",
            "event_type",
            F.expr("cast((day(ts) - 1) div 7 AS BIGINT)").alias("sale_id"),
            k.alias("product_id"),
        )

    @cached_property
    def order_requests(self) -> DataFrame:
        return self._stock_log.filter("event_type = 'purchase'").select(
            F.col("id").alias("request_id"),
            "user_id",
            "ts",
            "sale_id",
            "product_id",
            (1 + F.col("id") % 7).cast("int").alias("quantity"),
            (1 + F.col("product_id") % 3).cast("int").alias("total_qty"),
        )

    @cached_property
    def stock_events(self) -> DataFrame:
        return self._stock_log.filter("event_type IN ('purchase', 'error')").select(
            "id",
            "ts",
            "sale_id",
            "product_id",
            F.when(F.col("event_type") == "purchase", -1).otherwise(1).alias("delta"),
        )

    @cached_property
    def limiter_calls(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        )
