"""O17-O19, O26 — revenue and conversion trend, order rollup.

Plan shape for the trend: one aggregate per side, each grouped by the
period (partial aggregation map-side; the shuffle carries one row per
period and distinct key per map task), a join of two tables holding one row
per period, and a ``lag`` over a window ordered by period. That window has
no partition key, so it runs in one task — fine because its input has one
row per period (months or hours), never one per event or order.

Revenue is the unrounded sum of the prices, whatever order rows come in
(``functions.ratios``); growth is computed from the unrounded sum of the
previous *row* (not the previous calendar month), after the left join's
coalesce. Rows without a timestamp form a period of their own, NULL, which is
the last one.

Two distinct counts per side make Spark ``Expand`` every row into two. Callers
who know that order ids are unique (``order_id_unique``), or that a session
has one user (``session_determines_user``), can say so: ids that are unique
are only counted, and sessions are counted per user first, so no row is
copied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.ratios import exact_mean, pct, present_sql, total_sql
from shopmetrics.functions.sql import ident, lit, pct_sql
from shopmetrics.functions.time import period_start, period_text
from shopmetrics.operators.cohort import VALID_STATUSES, valid_orders


def _trend_base(events: DataFrame, orders: DataFrame, grain: str, visit_event: str,
                session: str | Sequence[str], user: str, ts: str, event_col: str,
                order_id: str, order_user: str, order_ts: str, value: str,
                status: str | None, status_in: Sequence[str], order_id_unique: bool,
                session_determines_user: bool) -> DataFrame:
    src = orders if status is None else valid_orders(orders, status, status_in)
    per_orders = (src.groupBy(period_start(orders, order_ts, grain).alias("_p"))
                  .agg((F.count(order_id) if order_id_unique else F.count_distinct(order_id)).alias("_orders"),
                       F.count_distinct(order_user).alias("_buyers"),
                       F.expr(total_sql(ident(value))).alias("_rev"),
                       F.expr(f"count({present_sql(ident(value))})").alias("_priced")))
    keys = [session] if isinstance(session, str) else list(session)
    visits = (events.where(f"{ident(event_col)} = {lit(visit_event)}")
              .select(period_start(events, ts, grain).alias("_p"), F.col(user).alias("_u"),
                      *[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)]))
    parts = [f"_s{i}" for i in range(len(keys))]
    if session_determines_user:
        known = " AND ".join(f"{c} IS NOT NULL" for c in parts)
        per_session = visits.groupBy("_p", "_u", *parts).agg(F.expr(f"max(CASE WHEN {known} THEN 1 ELSE 0 END)").alias("_n"))
        per_visits = (per_session.groupBy("_p", "_u").agg(F.sum("_n").alias("_n"))
                      .groupBy("_p").agg(F.expr("CAST(sum(_n) AS BIGINT)").alias("total_sessions"),
                                         F.count("_u").alias("unique_visitors")))
    else:
        per_visits = visits.groupBy("_p").agg(F.count_distinct(*parts).alias("total_sessions"),
                                              F.count_distinct("_u").alias("unique_visitors"))
    both = per_visits.join(per_orders, on="_p", how="left")
    prev = "lag(total_revenue) OVER (ORDER BY _p ASC NULLS LAST)"
    return both.selectExpr(
        "_p", "total_sessions", "unique_visitors",
        "coalesce(_orders, 0) AS total_orders",
        "coalesce(_buyers, 0) AS unique_buyers",
        "coalesce(_rev, 0.0D) AS total_revenue",
        "coalesce(_rev / nullif(CAST(_priced AS DOUBLE), 0.0D), 0.0D) AS avg_order_value",
    ).selectExpr("*", f"100.0D * (total_revenue - {prev}) / nullif({prev}, 0.0D) AS _growth")


def revenue_trend(events: DataFrame, orders: DataFrame, grain: str = "month", period: str | None = None,
                  visit_event: str = "home", session: str | Sequence[str] = "session_id", user: str = "user_id",
                  ts: str = "created_at", event_col: str = "event_type", order_id: str = "order_id",
                  order_user: str = "user_id", order_ts: str = "created_at",
                  value: str = "total_sale_price", status: str | None = "status",
                  status_in: Sequence[str] = VALID_STATUSES, order_id_unique: bool = False,
                  session_determines_user: bool = False) -> DataFrame:
    """O17 — per period with visits: ``{period}, total_sessions, unique_visitors,
    total_orders, unique_buyers, total_revenue`` (2), ``avg_order_value`` (2),
    ``visitor_conversion_pct`` (2), ``mom_revenue_growth_pct`` (1).

    A visit is a ``visit_event`` event; an order is a row of ``orders`` whose
    status is valid (``status=None``: every row). Periods with orders but no
    visits are dropped (left join from visits). ``period`` names the period
    column (default: the grain); ``session`` may name several columns.
    """
    name = period or grain
    base = _trend_base(events, orders, grain, visit_event, session, user, ts, event_col,
                       order_id, order_user, order_ts, value, status, status_in, order_id_unique,
                       session_determines_user)
    return base.selectExpr(
        f"_p AS {ident(name)}", "total_sessions", "unique_visitors", "total_orders", "unique_buyers",
        "round(total_revenue, 2) AS total_revenue",
        "round(avg_order_value, 2) AS avg_order_value",
        f"{pct_sql('unique_buyers', 'unique_visitors', 2)} AS visitor_conversion_pct",
        "round(_growth, 1) AS mom_revenue_growth_pct",
    ).orderBy(F.col(name).asc_nulls_last())


def revenue_trend_export(events: DataFrame, orders: DataFrame, grain: str = "month",
                         period: str | None = None, **kw) -> DataFrame:
    """O18 — the export form of O17: ``{period}, unique_visitors, total_revenue,
    unique_buyers, total_orders, avg_order_value`` (unrounded),
    ``conversion_pct`` (2), ``{period}_str`` and unrounded ``mom_growth``."""
    name = period or grain
    base = _trend_base(events, orders, grain,
                       kw.pop("visit_event", "home"), kw.pop("session", "session_id"),
                       kw.pop("user", "user_id"), kw.pop("ts", "created_at"),
                       kw.pop("event_col", "event_type"), kw.pop("order_id", "order_id"),
                       kw.pop("order_user", "user_id"), kw.pop("order_ts", "created_at"),
                       kw.pop("value", "total_sale_price"), kw.pop("status", "status"),
                       kw.pop("status_in", VALID_STATUSES), kw.pop("order_id_unique", False),
                       kw.pop("session_determines_user", False))
    if kw:
        raise TypeError(f"unexpected arguments: {sorted(kw)}")
    return base.select(
        F.col("_p").alias(name), "unique_visitors", "total_revenue", "unique_buyers", "total_orders",
        "avg_order_value",
        pct("unique_buyers", "unique_visitors", 2).alias("conversion_pct"),
        period_text("_p", grain).alias(f"{name}_str"),
        F.col("_growth").alias("mom_growth"),
    ).orderBy(F.col(name).asc_nulls_last())


def trend_summary(trend: DataFrame, period: str = "month", revenue: str = "total_revenue",
                  conversion: str = "conversion_pct") -> DataFrame:
    """O19 — one row: ``total_revenue`` (2), ``avg_conversion_pct`` (mean of the
    per-period rates) and ``peak_{period}`` (highest revenue, earliest on ties)."""
    r, p = ident(revenue), ident(period)
    return trend.agg(
        F.expr(f"round({total_sql(r)}, 2)").alias("total_revenue"),
        exact_mean(conversion).alias("avg_conversion_pct"),
        F.expr(f"min_by({p}, named_struct('r', -{r}, 'p', {p}))").alias(f"peak_{period}"),
    )


def order_rollup(items: DataFrame, order_id: str = "order_id", price: str = "sale_price") -> DataFrame:
    """O26 — per order: ``num_of_item`` (line items) and ``total_sale_price``
    (sum of item prices, 2 digits)."""
    return items.groupBy(order_id).agg(
        F.count(F.lit(1)).alias("num_of_item"),
        F.expr(f"round({total_sql(ident(price))}, 2)").alias("total_sale_price"))
