"""O06-O08 — monthly cohort retention.

A user's cohort is the month of their first valid order; month ``n`` of a
cohort counts its users with a valid order ``n`` calendar months later.

Plan shape: valid orders are first reduced to distinct (user, month) pairs
(partial aggregation map-side, so a user with a third of all orders leaves
each map task as at most one row per month). The cohort month is then a
``min`` over a window partitioned by user, on those pairs only — no second
scan of orders and no join back to them. Since the pairs are distinct, the
users of a cell are a plain conditional count, with no distinct count (and
no Expand), and grouping by cohort alone yields every cell of a cohort in
one row from one map-side-combined aggregation. Cohort size is the month-0
cell, which holds every member of the cohort by construction, so no window
or join over cohorts is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.ratios import exact_mean
from shopmetrics.functions.sql import ident, lit, pct_sql
from shopmetrics.functions.time import period_start

# Order statuses that count as a real purchase in the reference.
VALID_STATUSES = ("Complete", "Returned", "Shipped")


def valid_orders(orders: DataFrame, status: str = "status",
                 status_in: Sequence[str] = VALID_STATUSES) -> DataFrame:
    """Orders whose status is in ``status_in`` (NULL status is not)."""
    return orders.where(f"{ident(status)} IN ({', '.join(lit(v) for v in status_in)})")


def cohort_retention(orders: DataFrame, user: str = "user_id", ts: str = "created_at",
                     status: str | None = "status", status_in: Sequence[str] = VALID_STATUSES,
                     horizon: int = 12) -> DataFrame:
    """O06 — per (cohort_month, month_number in 0..horizon-1) with at least one
    returning user: ``cohort_size, retained_users, retention_pct`` (1 digit),
    sorted by both keys.

    ``status=None`` takes every row as a valid order.
    """
    return retention_cells(_cohort_counts(orders, user, ts, status, status_in, horizon), horizon)


def retention_cells(counts: DataFrame, horizon: int) -> DataFrame:
    """The rows of O06 from one row per cohort: ``cohort_month, c0, c1, ...``."""
    cells = ", ".join(f"{m}, c{m}" for m in range(horizon))
    return (counts.selectExpr("cohort_month", "c0 AS cohort_size",
                              f"stack({horizon}, {cells}) AS (month_number, retained_users)")
            .where("retained_users > 0")
            .selectExpr("cohort_month", "cohort_size", "month_number", "retained_users",
                        f"{pct_sql('retained_users', 'cohort_size', 1)} AS retention_pct")
            .orderBy("cohort_month", "month_number"))


def _cohort_counts(orders: DataFrame, user: str, ts: str, status: str | None, status_in: Sequence[str],
                   horizon: int) -> DataFrame:
    """One row per cohort: ``c{m}`` = its users with a valid order ``m`` months later."""
    pairs = order_months(orders, user, ts, status, status_in).withColumnRenamed(user, "_user")
    return cohort_counts(pairs.selectExpr("order_month", "min(order_month) OVER (PARTITION BY _user) AS cohort_month"), horizon)


def order_months(orders: DataFrame, user: str, ts: str, status: str | None, status_in: Sequence[str]) -> DataFrame:
    """Distinct ``(user, order_month)`` of valid orders; rows without user or time are left out."""
    src = orders if status is None else valid_orders(orders, status, status_in)
    return (src.where(f"{ident(user)} IS NOT NULL AND {ident(ts)} IS NOT NULL")
            .select(F.col(user), period_start(orders, ts, "month").alias("order_month"))
            .distinct())


def cohort_counts(pairs: DataFrame, horizon: int) -> DataFrame:
    """One row per cohort, ``c0, c1, ...``, from distinct user months as ``(order_month, cohort_month)``."""
    offsets = (pairs.selectExpr("cohort_month",
                                "CAST((year(order_month) - year(cohort_month)) * 12"
                                " + (month(order_month) - month(cohort_month)) AS INT) AS month_number")
               .where(f"month_number BETWEEN 0 AND {int(horizon) - 1}"))
    # Pairs are distinct, so a plain conditional count is the distinct user count
    # of a cell; grouping by cohort alone gives every cell of a cohort in one row.
    return offsets.groupBy("cohort_month").agg(
        *[F.expr(f"count_if(month_number = {m})").alias(f"c{m}") for m in range(horizon)])


def cohort_matrix(retention: DataFrame, horizon: int = 12, min_months: int = 3,
                  cohort: str = "cohort_month", month: str = "month_number",
                  value: str = "retention_pct") -> DataFrame:
    """O07 — wide form of O06: one row per cohort, columns ``"0"`` .. ``"{horizon-1}"``
    holding the retention, kept when at least ``min_months`` cells are filled.

    The pivot values are given, so the schema is fixed and Spark needs no
    extra job to find them; the pivot runs on the aggregated cells only.
    """
    months = list(range(horizon))
    wide = retention.groupBy(cohort).pivot(month, months).agg(F.max(value))
    filled = " + ".join(f"CASE WHEN {ident(str(m))} IS NULL THEN 0 ELSE 1 END" for m in months)
    return wide.where(f"{filled} >= {int(min_months)}").orderBy(cohort)


def cohort_average(matrix: DataFrame, months: Sequence[int] = (1, 3)) -> DataFrame:
    """O08 — one row: ``cohorts`` kept and ``avg_month_{m}`` per month, NULLs skipped."""
    return matrix.agg(F.count(F.lit(1)).alias("cohorts"),
                      *[exact_mean(str(m)).alias(f"avg_month_{m}") for m in months])
