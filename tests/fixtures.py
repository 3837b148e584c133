"""Small hand-made inputs with the canonical schemas (FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

EVENTS_DDL = ("event_id BIGINT, session_id BIGINT, user_id BIGINT, event_type STRING, "
              "created_at TIMESTAMP_NTZ, device_type STRING, traffic_source STRING")
ORDERS_DDL = ("order_id BIGINT, user_id BIGINT, status STRING, total_sale_price DOUBLE, "
              "created_at TIMESTAMP_NTZ")
USERS_DDL = "user_id BIGINT, traffic_source STRING"


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def events(spark: SparkSession, rows) -> DataFrame:
    """rows: (session_id, user_id, event_type, created_at, device_type, traffic_source)."""
    data = [(i, *r[:3], ts(r[3]) if isinstance(r[3], str) else r[3], *r[4:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, EVENTS_DDL)


def orders(spark: SparkSession, rows) -> DataFrame:
    """rows: (order_id, user_id, status, total_sale_price, created_at)."""
    data = [(*r[:4], ts(r[4]) if isinstance(r[4], str) else r[4]) for r in rows]
    return spark.createDataFrame(data, ORDERS_DDL)


def as_dicts(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
