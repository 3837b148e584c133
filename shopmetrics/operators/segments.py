"""O20 — customers by lifetime spend tier.

Tiers are right-closed: with bounds 0 < 50 < 150 < 400 a total of exactly
50 is in the first tier, and a total of 0 or less, or no total at all (only
missing prices), is in none and is left out. Totals are compared unrounded. Spark ML's ``Bucketizer`` is left-closed, so the tier is a ``CASE``
chain instead.

Plan shape: one aggregate per customer (partial map-side), a tier label,
one aggregate per tier; the revenue share divides by a window sum over the
per-tier rows (a handful of rows), never over customers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.ratios import total_sql
from shopmetrics.functions.sql import ident, lit
from shopmetrics.operators.cohort import VALID_STATUSES, valid_orders

# The reference's tier bounds (right-closed) and labels.
DEFAULT_BOUNDS = (0.0, 50.0, 150.0, 400.0)
DEFAULT_LABELS = ("Low (<$50)", "Mid ($50-$150)", "High ($150-$400)", "VIP (>$400)")


def _tier_sql(spend: str, bounds: Sequence[float], labels: Sequence[str]) -> tuple[str, str]:
    """(ordinal, label) SQL of the right-closed tier; NULL without spend and at or below the first bound."""
    if len(labels) != len(bounds):
        raise ValueError("need one label per lower bound (the last tier is open-ended)")
    b = [repr(float(x)) + "D" for x in bounds]
    no = " ".join(f"WHEN {spend} <= {b[i]} THEN {i - 1}" for i in range(1, len(b)))
    label = " ".join(f"WHEN {spend} <= {b[i]} THEN {lit(labels[i - 1])}" for i in range(1, len(b)))
    head = f"CASE WHEN {spend} IS NULL OR {spend} <= {b[0]} THEN NULL "
    return (f"{head}{no} ELSE {len(b) - 1} END", f"{head}{label} ELSE {lit(labels[-1])} END")


def spend_segments(orders: DataFrame, user: str = "user_id", value: str = "total_sale_price",
                   order_id: str = "order_id", bounds: Sequence[float] = DEFAULT_BOUNDS,
                   labels: Sequence[str] = DEFAULT_LABELS, status: str | None = "status",
                   status_in: Sequence[str] = VALID_STATUSES) -> DataFrame:
    """O20 — per tier with at least one customer, in tier order: ``segment,
    customers, avg_spend, avg_orders, total_revenue`` (2),
    ``revenue_share_pct`` (1). Customers with a NULL key are left out."""
    src = orders if status is None else valid_orders(orders, status, status_in)
    per_user = (src.where(f"{ident(user)} IS NOT NULL").groupBy(user)
                .agg(F.expr(total_sql(ident(value))).alias("_spend"),
                     F.count(order_id).alias("_orders")))
    no, label = _tier_sql("_spend", bounds, labels)
    tiers = (per_user.selectExpr(f"{no} AS _tier", f"{label} AS segment", "_spend", "_orders")
             .where("_tier IS NOT NULL")
             .groupBy("_tier", "segment")
             .agg(F.count(F.lit(1)).alias("customers"),
                  F.expr(total_sql("_spend")).alias("_rev"), F.sum("_orders").alias("_n")))
    # The share's window runs over one row per tier (a handful), never over customers.
    return (tiers.selectExpr(
        "_tier", "segment", "customers",
        "_rev / nullif(CAST(customers AS DOUBLE), 0.0D) AS avg_spend",
        "CAST(_n AS DOUBLE) / nullif(CAST(customers AS DOUBLE), 0.0D) AS avg_orders",
        "round(_rev, 2) AS total_revenue",
        "round(100.0D * _rev / nullif(sum(_rev) OVER (), 0.0D), 1)"
        " AS revenue_share_pct",
    ).orderBy("_tier").drop("_tier"))
