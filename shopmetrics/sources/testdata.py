"""Adapters from the driver's test tables to the canonical tables.

The test tables are a TPC-H-like star schema plus an ``events`` table; used
as they stand most operators would be degenerate (every user has every
event type, one month of events, no session, device or source column). The
adapters below derive the canonical columns with plain expressions, each of
which has an exact DuckDB counterpart in ``shopmetrics.plans.oracle``:

=================  ===========================================================
canonical          derived from
=================  ===========================================================
session            ``(user_id, session_day)``, the date of ``ts``: one session per user-day
events.device_type ``k`` of the JSON ``props``: < 52 mobile, < 90 desktop, else tablet
traffic_source     ``customer.c_mktsegment`` of the event's user
funnel stages      view -> click -> signup -> purchase (``error`` is outside)
users              ``customer``
orders             ``orders`` (valid = status F or O), 80 months of history
event orders       events: ``event_id``, ``user_id``, ``event_type`` as status, ``ts``, ``value``
order_items        ``lineitem``
products           ``part``
=================  ===========================================================

Everything stays lazy; only the columns a query uses are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the test-table mapping (see the table above).
TEST_STAGES = ("view", "click", "signup", "purchase")
TEST_VALID_STATUSES = ("F", "O")
DEVICE_CUTS = ((52, "mobile"), (90, "desktop"))
DEVICE_OTHER = "tablet"


SESSION = ("user_id", "session_day")  # the columns of a session's key


# Declared schemas of the test tables read here: no footer-reading inference
# pass at planning time (it cost more than running some of the queries).
TEST_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
              "props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if name in TEST_SCHEMAS:
        return spark.read.schema(TEST_SCHEMAS[name]).parquet(path)
    return spark.read.parquet(path)


def events(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """Canonical events. ``nulls=True`` turns ``error`` event types into NULLs,
    giving the null audits something to find."""
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    device = " ".join(f"WHEN {k} < {cut} THEN '{name}'" for cut, name in DEVICE_CUTS)
    etype = "nullif(event_type, 'error')" if nulls else "event_type"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "to_date(ts) AS session_day",
        "user_id",
        f"{etype} AS event_type",
        "ts AS created_at",
        f"CASE {device} ELSE '{DEVICE_OTHER}' END AS device_type",
        "value",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id", "c_name AS name", "c_nationkey AS country", "c_acctbal AS balance",
        "c_mktsegment AS traffic_source")


def orders(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """Canonical orders. ``nulls=True`` turns status P into NULL."""
    status = "nullif(o_orderstatus, 'P')" if nulls else "o_orderstatus"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id", "o_custkey AS user_id", f"{status} AS status",
        "o_totalprice AS total_sale_price", "o_orderdate AS created_at", "o_orderpriority AS priority")


def valid_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = ", ".join(f"'{s}'" for s in TEST_VALID_STATUSES)
    return orders(spark, sf_dir).where(f"status IN ({statuses})")


def order_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a ``home`` visit (session = order), for month-grain trends:
    the events table spans one month only."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS session_id", "o_custkey AS user_id", "o_orderdate AS created_at",
        "'home' AS event_type")


EVENT_ORDER_STATUS = ("purchase",)  # the status of an event that is a valid order


def event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an order whose status is its type: long-tailed amounts over one month."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS order_id", "user_id", "to_date(ts) AS session_day", "event_type AS status",
        "value AS total_sale_price", "ts AS created_at")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_id", "l_linenumber AS line_number", "l_partkey AS product_id",
        "l_extendedprice AS sale_price", "l_returnflag AS status", "l_shipdate AS shipped_at")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id", "p_name AS product_name", "p_type AS category", "p_brand AS brand",
        "p_retailprice AS retail_price")
