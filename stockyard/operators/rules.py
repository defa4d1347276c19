"""Checks of incoming rows; the first failing rule of a row decides its error."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.functions.scalars import blank_to_null, parse_float, parse_int, present, trim_all

# Accepted upload types and size.
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp")
MAX_UPLOAD_BYTES = 5 * 1024 * 1024
MAX_INT = 2**31 - 1

# Code, status and text of the rejections.
REJECTIONS = {
    "products.MISSING_FIELDS": ("MISSING_FIELDS", 400, "name and base_price are required."),
    "products.INVALID_PRICE": ("INVALID_PRICE", 400, "base_price must be a positive number."),
    "products.PRICE_OUT_OF_RANGE": ("PRICE_OUT_OF_RANGE", 500, "numeric field overflow"),
    "sales.START_NOT_FUTURE": ("START_NOT_FUTURE", 400, "start_time must be in the future."),
    "sales.END_BEFORE_START": ("END_BEFORE_START", 400, "end_time must be after start_time."),
    "sale_products.INVALID_PRICE": ("INVALID_PRICE", 400, "sale_price must be a positive number."),
    "sale_products.INVALID_QTY": ("INVALID_QTY", 400, "total_qty must be a positive integer."),
    "sale_products.SALE_NOT_FOUND": ("SALE_NOT_FOUND", 404, "Sale not found."),
    "sale_products.PRODUCT_NOT_FOUND": ("PRODUCT_NOT_FOUND", 404, "Product not found or inactive."),
    "order_requests.INVALID_QUANTITY": ("INVALID_QUANTITY", 400, "quantity must be between 1 and 5."),
    "registrations.SHORT_PASSWORD": ("SHORT_PASSWORD", 400, "Password must be at least 6 characters."),
    "uploads.FILE_TOO_LARGE": ("FILE_TOO_LARGE", 400, "File too large. Maximum size is 5MB."),
    "sales.MISSING_FIELDS": ("MISSING_FIELDS", 400, "name, start_time and end_time are required."),
    "sales.INVALID_DATE": ("INVALID_DATE", 400, "Invalid date format. Use ISO 8601 (e.g. 2026-03-20T14:00:00Z)."),
    "sale_products.MISSING_FIELDS": ("MISSING_FIELDS", 400, "product_id, sale_price and total_qty are required."),
    "sale_products.OUT_OF_RANGE": ("OUT_OF_RANGE", 500, "numeric value out of range"),
    "order_requests.MISSING_FIELDS": ("MISSING_FIELDS", 400, "sale_id and sale_product_id are required."),
    "registrations.MISSING_FIELDS": ("MISSING_FIELDS", 400, "email, password and full_name are required."),
    "uploads.UNSUPPORTED_TYPE": ("UNSUPPORTED_TYPE", 400, "Only JPEG, PNG and WebP images are allowed."),
}


@dataclass(frozen=True)
class Rule:
    fails: Column
    code: str
    http_class: int
    message: str | Column


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add error_code, http_class and message, all NULL on rows that pass."""

    def first(pick) -> Column:
        chain = reduce(lambda c, r: c.when(r.fails, pick(r)), rules[1:], F.when(rules[0].fails, pick(rules[0])))
        return chain

    def as_column(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return df.select(
        "*",
        first(lambda r: as_column(r.code)).alias("error_code"),
        first(lambda r: as_column(r.http_class)).alias("http_class"),
        first(lambda r: as_column(r.message)).alias("message"),
    )


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter("error_code IS NULL").drop("error_code", "http_class", "message")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter("error_code IS NOT NULL")


def _bad_price(price: Column) -> Column:
    return price.isNull() | (price <= 0)


def _price_overflow(price: Column) -> Column:
    return price >= 99_999_999.995


def dq_products(df: DataFrame) -> DataFrame:
    """name, description and base_price as text."""
    price = parse_float(F.col("base_price"))
    checked = validate(
        df.withColumn("price", price),
        [
            Rule(_missing("name", "base_price"), *REJECTIONS["products.MISSING_FIELDS"]),
            Rule(_bad_price(F.col("price")), *REJECTIONS["products.INVALID_PRICE"]),
            Rule(_price_overflow(F.col("price")), *REJECTIONS["products.PRICE_OUT_OF_RANGE"]),
        ],
    )
    ok = F.col("error_code").isNull()
    return (
        checked.withColumn("name", F.when(ok, trim_all(F.col("name"))).otherwise(F.col("name")))
        .withColumn(
            "description", F.when(ok, blank_to_null(F.col("description"))).otherwise(F.col("description"))
        )
        .withColumn("price", F.when(ok, F.col("price").try_cast("decimal(10,2)")))
    )


def _missing(*names: str) -> Column:
    return ~reduce(lambda a, b: a & b, [F.coalesce(present(F.col(n)), F.lit(False)) for n in names])


def dq_sales(df: DataFrame, as_of: Column) -> DataFrame:
    """name, start_time and end_time as text."""
    timed = df.withColumn("start_ts", F.col("start_time").try_cast("timestamp").cast("timestamp_ntz")).withColumn(
        "end_ts", F.col("end_time").try_cast("timestamp").cast("timestamp_ntz")
    )
    return validate(
        timed,
        [
            Rule(
                _missing("name", "start_time", "end_time"),
                *REJECTIONS["sales.MISSING_FIELDS"],
            ),
            Rule(
                F.col("start_ts").isNull() | F.col("end_ts").isNull(),
                *REJECTIONS["sales.INVALID_DATE"],
            ),
            Rule(F.col("start_ts") <= as_of, *REJECTIONS["sales.START_NOT_FUTURE"]),
            Rule(F.col("end_ts") <= F.col("start_ts"), *REJECTIONS["sales.END_BEFORE_START"]),
        ],
    )


def dq_sale_products(df: DataFrame, sales: DataFrame, products: DataFrame) -> DataFrame:
    """sale_id and product_id as keys, sale_price and total_qty as text."""
    looked_up = (
        df.withColumn("price", parse_float(F.col("sale_price")))
        .withColumn("qty", parse_int(F.col("total_qty")))
        .join(sales.select(F.col("id").alias("sale_id"), F.col("status").alias("sale_status")), "sale_id", "left")
        .join(
            products.filter("is_active").select(F.col("id").alias("product_id"), F.lit(True).alias("_product")),
            "product_id",
            "left",
        )
    )
    status = F.col("sale_status")
    checked = validate(
        looked_up,
        [
            Rule(
                F.col("product_id").isNull() | _missing("sale_price", "total_qty"),
                *REJECTIONS["sale_products.MISSING_FIELDS"],
            ),
            Rule(_bad_price(F.col("price")), *REJECTIONS["sale_products.INVALID_PRICE"]),
            Rule(_bad_price(F.col("qty")), *REJECTIONS["sale_products.INVALID_QTY"]),
            Rule(status.isNull(), *REJECTIONS["sale_products.SALE_NOT_FOUND"]),
            Rule(
                status != "SCHEDULED",
                "SALE_NOT_SCHEDULED",
                400,
                F.concat(F.lit("Cannot add products to a sale with status: "), status, F.lit(".")),
            ),
            Rule(F.col("_product").isNull(), *REJECTIONS["sale_products.PRODUCT_NOT_FOUND"]),
            Rule(
                _price_overflow(F.col("price")) | (F.col("qty") > MAX_INT),
                *REJECTIONS["sale_products.OUT_OF_RANGE"],
            ),
        ],
    )
    return checked.drop("_product", "sale_status")


def dq_order_requests(df: DataFrame) -> DataFrame:
    """quantity defaults to 1 and must be a whole number from 1 to 5."""
    filled = df.withColumn("quantity", F.coalesce("quantity", F.lit(1)))
    q = F.col("quantity")
    return validate(
        filled,
        [
            Rule(
                F.col("sale_id").isNull() | F.col("sale_product_id").isNull(),
                *REJECTIONS["order_requests.MISSING_FIELDS"],
            ),
            Rule(
                (q < 1) | (q > 5) | (q != F.floor(q)), *REJECTIONS["order_requests.INVALID_QUANTITY"]
            ),
        ],
    )


def dq_registrations(df: DataFrame, users: DataFrame) -> DataFrame:
    """email, password, full_name with ts and id; an address is taken by the first valid request.

    The first request per address is found by an aggregate, so many requests
    for one address are combined before the shuffle.
    """
    named = df.withColumn("email_key", trim_all(F.lower("email")))
    own = validate(
        named,
        [
            Rule(
                _missing("email", "password", "full_name"),
                *REJECTIONS["registrations.MISSING_FIELDS"],
            ),
            Rule(
                F.length("password") < 6, *REJECTIONS["registrations.SHORT_PASSWORD"]
            ),
        ],
    )
    first = (
        own.filter("error_code IS NULL")
        .groupBy("email_key")
        .agg(F.min(F.struct("ts", "id")).getField("id").alias("_first"))
    )
    taken = users.select(F.col("email").alias("email_key"), F.lit(True).alias("_user"))
    looked_up = own.join(first, "email_key", "left").join(taken, "email_key", "left")
    late = F.col("error_code").isNull() & (F.col("_user").isNotNull() | (F.col("id") != F.col("_first")))
    return (
        looked_up.withColumn("http_class", F.when(late, 409).otherwise(F.col("http_class")))
        .withColumn(
            "message", F.when(late, "An account with this email already exists.").otherwise(F.col("message"))
        )
        .withColumn("error_code", F.when(late, "EMAIL_TAKEN").otherwise(F.col("error_code")))
        .withColumn("full_name", trim_all(F.col("full_name")))
        .drop("_first", "_user")
    )


def dq_uploads(df: DataFrame) -> DataFrame:
    """mime and size of an optional image; adds its extension."""
    checked = validate(
        df,
        [
            Rule(
                ~F.col("mime").isin(*IMAGE_TYPES),
                *REJECTIONS["uploads.UNSUPPORTED_TYPE"],
            ),
            Rule(
                F.col("size") > MAX_UPLOAD_BYTES, *REJECTIONS["uploads.FILE_TOO_LARGE"]
            ),
        ],
    )
    return checked.withColumn(
        "extension", F.when(F.col("error_code").isNull(), F.split("mime", "/")[1])
    )
