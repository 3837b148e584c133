"""Registered queries: each operator bound to the test tables.

``QUERIES[name](spark, sf_dir)`` returns a lazy DataFrame over the whole
test tables of ``sf_dir``; ``shopmetrics.plans.oracle.ORACLE_SQL[name]`` is
the same query written independently as DuckDB SQL over the raw tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.functions.sql import one_row_per_key
from shopmetrics.operators import cohort, funnel, quality, quantiles, revenue, segments, summary, visitors
from shopmetrics.operators.cohort_state import CohortState
from shopmetrics.sources import testdata as td
from shopmetrics.sources.convert import bad_record_counts, convert_csv, observed_counts
from shopmetrics.sources.scratch import scratch_folder, written

S = td.TEST_STAGES
VALID = td.TEST_VALID_STATUSES
SESSION = td.SESSION
# Customers' totals over valid orders have quartiles near 1.1, 1.6 and 2.1 million.
TIER_BOUNDS = (0.0, 1.0e6, 1.5e6, 2.0e6)
TIER_LABELS = ("Low (<1.0M)", "Mid (1.0M-1.5M)", "High (1.5M-2.0M)", "VIP (>2.0M)")
TOP_TIER = TIER_LABELS[-1]


def _source_lookup(spark: SparkSession, sf_dir: str) -> dict:
    return dict(lookup=td.users(spark, sf_dir).select("user_id", "traffic_source"),
                lookup_key="user_id", unit_determines_key=True)


def q_funnel_overall(spark, d):
    return funnel.funnel_overall(td.events(spark, d), unit=SESSION, stages=S)


def q_funnel_long(spark, d):
    return funnel.funnel_long(td.events(spark, d), unit=SESSION, stages=S)


def q_funnel_by_source(spark, d):
    return funnel.funnel_by(td.events(spark, d), "traffic_source", unit=SESSION, stages=S,
                            **_source_lookup(spark, d))


def q_funnel_by_source_compact(spark, d):
    return funnel.funnel_by_compact(td.events(spark, d), "traffic_source", unit=SESSION, stages=S,
                                    **_source_lookup(spark, d))


def q_funnel_by_device(spark, d):
    return funnel.funnel_by_device(td.events(spark, d), "device_type", unit=SESSION, stages=S)


def q_funnel_dimensions(spark, d):
    """Overall, by traffic source and by device, in one pass over the events."""
    users = td.users(spark, d).select("user_id", "traffic_source")
    return funnel.funnel_dimensions(td.events(spark, d), ["traffic_source", "device_type"], unit=SESSION, stages=S,
                                    lookup=users, lookup_key="user_id")


def q_cohort_retention(spark, d):
    return cohort.cohort_retention(td.orders(spark, d), status_in=VALID)


def q_cohort_retention_kept(spark, d):
    """O06 from cohorts kept between two runs: the orders since 1998 (or undated), and then, late, the
    earlier ones, which move most users to other cohorts."""
    orders, state = td.orders(spark, d), CohortState(spark, f"{scratch_folder(spark)}/cohorts", status_in=VALID)
    year = F.year("created_at")
    for run in ((year >= 1998) | year.isNull(), year < 1998):
        state.add(orders.where(run))
    return state.retention().orderBy("cohort_month", "month_number")


def q_cohort_matrix(spark, d):
    return cohort.cohort_matrix(q_cohort_retention(spark, d))


def q_cohort_average(spark, d):
    return cohort.cohort_average(q_cohort_matrix(spark, d), months=(1, 3))


def q_null_audit_union(spark, d):
    events = td.events(spark, d, nulls=True).withColumnRenamed("session_day", "session_id")
    return quality.null_audit_union(events, td.orders(spark, d, nulls=True),
                                    lookup=td.users(spark, d).select("user_id", "traffic_source"),
                                    lookup_key="user_id")


def q_null_audit(spark, d):
    return quality.null_audit_tables({"events": td.events(spark, d, nulls=True), "users": td.users(spark, d),
                                      "orders": td.orders(spark, d, nulls=True)})


def q_converted_orders(spark, d):
    """Row, NULL and bad-row counts observed while orders are converted from CSV: the number of items of a
    pending order is a fraction there, which the declared schema cannot take."""
    folder = scratch_folder(spark)
    raw = td.orders(spark, d).selectExpr(
        "order_id", "user_id", "status", "CASE WHEN status = 'P' THEN CAST(total_sale_price AS STRING) ELSE '1' END AS num_of_item",
        "total_sale_price", "created_at", "nullif(priority, '1-URGENT') AS traffic_source")
    raw.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{folder}/csv")
    found = [convert_csv(spark, f"{folder}/csv", f"{folder}/orders", "orders", "quarantine")]
    bad = bad_record_counts(spark, found).selectExpr("table_name", "'(bad rows)' AS column_name", "bad_rows AS n")
    return observed_counts(spark, found, ("orders",)).unionByName(bad)


def q_duplicate_keys(spark, d):
    return quality.duplicate_keys(td.events(spark, d), (*SESSION, "event_type"), limit=20)


def q_duplicate_key_count(spark, d):
    return quality.duplicate_key_count(td.events(spark, d), (*SESSION, "event_type"))


def q_orphan_count(spark, d):
    return quality.orphan_count(td.orders(spark, d), td.order_items(spark, d), "order_id", "order_id",
                                name="orders_without_items")


def q_orphan_event_rows(spark, d):
    return quality.orphan_count(td.events(spark, d), td.users(spark, d), "user_id", "user_id")


def q_stage_integrity(spark, d):
    return quality.stage_integrity(td.events(spark, d), SESSION, requires="click", stage="purchase")


def q_zscore_outliers(spark, d):
    return quality.zscore_outliers(td.event_orders(spark, d), "total_sale_price", "order_id", k=3)


def q_outlier_summary(spark, d):
    return quality.outlier_summary(td.event_orders(spark, d), "total_sale_price", k=3)


def _event_trend(spark, d):
    """Views as visits and purchases as orders, hour by hour (some hours have no order)."""
    return dict(events=td.events(spark, d), orders=td.event_orders(spark, d), grain="hour", visit_event="view",
                session=SESSION, status_in=td.EVENT_ORDER_STATUS, order_id_unique=True,
                session_determines_user=True)


def q_revenue_trend_hourly(spark, d):
    return revenue.revenue_trend(**_event_trend(spark, d))


def q_revenue_trend_monthly(spark, d):
    return revenue.revenue_trend(td.order_visits(spark, d), td.orders(spark, d), grain="month",
                                 status_in=VALID, order_id_unique=True, session_determines_user=True)


def q_revenue_trend_export(spark, d):
    return revenue.revenue_trend_export(**_event_trend(spark, d))


def q_trend_summary(spark, d):
    return revenue.trend_summary(q_revenue_trend_export(spark, d), period="hour")


def q_spend_segments(spark, d):
    return segments.spend_segments(td.orders(spark, d), bounds=TIER_BOUNDS, labels=TIER_LABELS, status_in=VALID)


def q_kpi_summary(spark, d):
    # A session has one user and a user one source, so the overall funnel is the
    # sum of the per-source one: both come from one pass over the events.
    counts = funnel.stage_counts(td.events(spark, d), ["traffic_source"], SESSION, S, **_source_lookup(spark, d))
    return summary.kpi_summary(
        funnel=summary.funnel_and_sources(counts, S), sources=None,
        matrix=q_cohort_matrix(spark, d),
        segments=q_spend_segments(spark, d),
        orders=td.valid_orders(spark, d),
        top_tier=TOP_TIER,
    )


def _tables(spark, d):
    return {"events": td.events(spark, d), "users": td.users(spark, d), "orders": td.orders(spark, d),
            "order_items": td.order_items(spark, d), "products": td.products(spark, d)}


def q_row_counts(spark, d):
    return quality.row_counts(_tables(spark, d))


def q_order_status_counts(spark, d):
    return quality.value_distribution(td.orders(spark, d), "status")


def q_order_status_share(spark, d):
    return quality.value_distribution(td.orders(spark, d), "status", normalize=True)


def q_event_type_share(spark, d):
    return quality.value_distribution(td.events(spark, d), "event_type", normalize=True)


def q_event_type_counts(spark, d):
    return quality.value_distribution(td.events(spark, d), "event_type")


def q_traffic_source_share(spark, d):
    return quality.value_distribution(td.users(spark, d), "traffic_source", normalize=True)


def q_order_source_share(spark, d):
    """Traffic source of orders: the source of each order's user, counted per user before the join."""
    per_user = td.orders(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    source = one_row_per_key(td.users(spark, d), "user_id", ["traffic_source"])
    return quality.value_distribution(per_user.join(source, "user_id", "left"), "traffic_source", normalize=True,
                                      weight="_n")


def q_population_profile(spark, d):
    return quality.population_profile(td.events(spark, d), td.orders(spark, d))


def q_order_rollup(spark, d):
    return revenue.order_rollup(td.order_items(spark, d), "order_id", "sale_price")


def q_order_value_quantiles(spark, d):
    """Median, p90 and p99 of order value by the traffic source of the order's user."""
    source = one_row_per_key(td.users(spark, d), "user_id", ["traffic_source"])
    orders = td.orders(spark, d).select("user_id", "total_sale_price").join(source, "user_id", "left")
    return quantiles.exact_quantiles(orders, "total_sale_price", (0.5, 0.9, 0.99), "traffic_source")


def q_visitors_by_grain(spark, d):
    """Visitors per hour, day and month: the last two from the stored hours, without the events."""
    events, folder = td.events(spark, d).select("user_id", "created_at"), scratch_folder(spark)
    numbers = written(visitors.number_users(events), folder, "numbers")
    return visitors.visitors_by_grain(written(visitors.period_sets(events, numbers, "hour"), folder, "hours"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "funnel_overall": q_funnel_overall,                      # O01
    "funnel_long": q_funnel_long,                            # O02
    "funnel_by_source": q_funnel_by_source,                  # O03
    "funnel_by_source_compact": q_funnel_by_source_compact,  # O04
    "funnel_by_device": q_funnel_by_device,                  # O05
    "funnel_dimensions": q_funnel_dimensions,                # O01, O03 and O05's counts in one pass
    "cohort_retention": q_cohort_retention,                  # O06
    "cohort_retention_kept": q_cohort_retention_kept,        # O06, cohorts kept between runs
    "cohort_matrix": q_cohort_matrix,                        # O07
    "cohort_average": q_cohort_average,                      # O08
    "null_audit_union": q_null_audit_union,                  # O09
    "null_audit": q_null_audit,                              # O10
    "duplicate_keys": q_duplicate_keys,                      # O11
    "duplicate_key_count": q_duplicate_key_count,            # O12
    "orphan_count": q_orphan_count,                          # O13, orders without line items
    "orphan_event_rows": q_orphan_event_rows,                # O13, events without a user
    "stage_integrity": q_stage_integrity,                    # O14
    "zscore_outliers": q_zscore_outliers,                    # O15
    "outlier_summary": q_outlier_summary,                    # O16
    "revenue_trend_hourly": q_revenue_trend_hourly,          # O17, hour grain
    "revenue_trend_monthly": q_revenue_trend_monthly,        # O17, month grain
    "revenue_trend_export": q_revenue_trend_export,          # O18
    "trend_summary": q_trend_summary,                        # O19
    "spend_segments": q_spend_segments,                      # O20
    "kpi_summary": q_kpi_summary,                            # O21
    "row_counts": q_row_counts,                              # O22
    "order_status_counts": q_order_status_counts,            # O23
    "order_status_share": q_order_status_share,              # O23, normalised
    "event_type_counts": q_event_type_counts,                # O23
    "order_source_share": q_order_source_share,              # O23, normalised, source of orders
    "event_type_share": q_event_type_share,                  # O23, normalised
    "traffic_source_share": q_traffic_source_share,          # O23, normalised
    "population_profile": q_population_profile,              # O24
    "order_rollup": q_order_rollup,                          # O26
    "order_value_quantiles": q_order_value_quantiles,        # exact quantiles
    "visitors_by_grain": q_visitors_by_grain,                # mergeable distinct counts
    "converted_orders": q_converted_orders,                  # CSV scan: O10 and O22 observed, bad rows set aside
}
