"""Table schemas, event body schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
MONEY_SUM = T.DecimalType(20, 2)

# Status words, event types and queue names of the data model.
ORDER_STATUSES = ("PENDING", "CONFIRMED", "FAILED")
LIVE_ORDER_STATUSES = ("PENDING", "CONFIRMED")
SALE_STATUSES = ("SCHEDULED", "ACTIVE", "ENDED")
EVENT_QUEUES = {
    "ORDER_CREATED": "order.created",
    "PAYMENT_SUCCESS": "payment.success",
    "PAYMENT_FAILED": "payment.failed",
}
STUCK_REASON = "Payment processing timed out. Please try again."
STUCK_PRODUCT_NAME = "Your order"


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "BINARY": T.BinaryType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampType(),
    "MONEY": MONEY,
}


def struct(spec: str) -> T.StructType:
    """'id BIGINT, name STRING' as a StructType, without needing a session."""
    pairs = [field.split() for field in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES = {
    "users": struct(
        "id BIGINT, email STRING, full_name STRING, role STRING, is_active BOOLEAN, created_at TIMESTAMP_NTZ"
    ),
    "products": struct(
        "id BIGINT, name STRING, description STRING, base_price MONEY, image_key STRING, "
        "is_active BOOLEAN, created_at TIMESTAMP_NTZ"
    ),
    "sales": struct(
        "id BIGINT, name STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, status STRING, "
        "created_at TIMESTAMP_NTZ"
    ),
    "sale_products": struct(
        "id BIGINT, sale_id BIGINT, product_id BIGINT, sale_price MONEY, total_qty INT, reserved_qty INT"
    ),
    "inventory": struct("id BIGINT, sale_product_id BIGINT, available_qty INT, last_synced_at TIMESTAMP_NTZ"),
    "orders": struct(
        "id BIGINT, user_id BIGINT, sale_id BIGINT, idempotency_key STRING, status STRING, "
        "total_amount MONEY, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "order_items": struct("id STRING, order_id BIGINT, product_id BIGINT, quantity INT, unit_price MONEY"),
    "outbox": struct(
        "id BIGINT, event_type STRING, payload STRING, published BOOLEAN, created_at TIMESTAMP_NTZ"
    ),
}

COUNTERS = struct("sale_product_id BIGINT, live_qty INT")

EVENT_BODIES = {
    "ORDER_CREATED": struct(
        "orderId STRING, userId STRING, saleId STRING, saleProductId STRING, productId STRING, "
        "productName STRING, quantity INT, unitPrice MONEY, totalAmount STRING, idempotencyKey STRING"
    ),
    "PAYMENT_SUCCESS": struct(
        "orderId STRING, userId STRING, transactionId STRING, amount STRING, productName STRING"
    ),
    "PAYMENT_FAILED": struct("orderId STRING, userId STRING, reason STRING, productName STRING, amount STRING"),
}
