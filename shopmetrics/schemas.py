"""Canonical input schemas (declared, never inferred).

Column names here are the defaults of every operator; each operator also
takes its column names as arguments, so other layouts work unchanged.
Timestamps are wall-clock times without a zone (``TIMESTAMP_NTZ``), so no
period depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _s(*fields: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


USERS = _s(
    ("user_id", LongType(), False),
    ("age", IntegerType(), True),
    ("gender", StringType(), True),
    ("country", StringType(), True),
    ("state", StringType(), True),
    ("traffic_source", StringType(), True),
    ("created_at", TimestampNTZType(), True),
)

EVENTS = _s(
    ("event_id", LongType(), False),
    ("session_id", LongType(), True),
    ("user_id", LongType(), True),
    ("event_type", StringType(), True),
    ("created_at", TimestampNTZType(), True),
    ("device_type", StringType(), True),
    ("browser", StringType(), True),
    ("traffic_source", StringType(), True),
    ("uri", StringType(), True),
    ("product_id", LongType(), True),
)

ORDERS = _s(
    ("order_id", LongType(), False),
    ("user_id", LongType(), True),
    ("status", StringType(), True),
    ("num_of_item", IntegerType(), True),
    ("total_sale_price", DoubleType(), True),
    ("created_at", TimestampNTZType(), True),
    ("traffic_source", StringType(), True),
)

ORDER_ITEMS = _s(
    ("order_item_id", LongType(), False),
    ("order_id", LongType(), True),
    ("user_id", LongType(), True),
    ("product_id", LongType(), True),
    ("status", StringType(), True),
    ("sale_price", DoubleType(), True),
    ("created_at", TimestampNTZType(), True),
    ("shipped_at", TimestampNTZType(), True),
    ("returned_at", TimestampNTZType(), True),
)

PRODUCTS = _s(
    ("product_id", LongType(), False),
    ("product_name", StringType(), True),
    ("category", StringType(), True),
    ("brand", StringType(), True),
    ("retail_price", DoubleType(), True),
    ("cost", DoubleType(), True),
    ("department", StringType(), True),
)

TABLES: dict[str, StructType] = {
    "users": USERS,
    "events": EVENTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "products": PRODUCTS,
}
