"""O21 — the KPI summary.

Each input is a small result (a few stages, sources, cohorts, tiers) or, for
the order totals, a global aggregate; each is reduced to exactly one row,
whose values are attached to the first as scalar subqueries: no join, and
nothing broadcast whose size could grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.ratios import exact_mean, pct, total_sql
from shopmetrics.functions.sql import ident, lit
from shopmetrics.operators.funnel import long_rows, stage_totals


def _funnel_part() -> list:
    """Aggregates over the rows of O02."""
    d, n, st = "drop_off_pct", "stage_no", "stage"
    return [
        F.expr("max_by(conversion_from_top_pct, stage_no)").alias("overall_conversion_pct"),
        F.expr(f"min_by(CASE WHEN {d} IS NOT NULL THEN {st} END, "
               f"CASE WHEN {d} IS NOT NULL THEN named_struct('d', -{d}, 'n', {n}) END)").alias("worst_dropoff_stage"),
        F.max(d).alias("worst_dropoff_pct"),
    ]


def _source_part(source_col: str) -> list:
    """Aggregates over the rows of O04; sources without a rate do not count."""
    c, src = "conversion_pct", ident(source_col)
    key = f"CASE WHEN {c} IS NOT NULL THEN named_struct('c', -{c}, 's', {src}) END"
    return [
        F.expr(f"min_by({src}, {key})").alias("best_source"),
        F.max(c).alias("best_source_conversion_pct"),
        F.expr(f"max_by({src}, {key})").alias("worst_source"),
        F.min(c).alias("worst_source_conversion_pct"),
    ]


def funnel_and_sources(counts: DataFrame, stages: Sequence[str], source_col: str = "traffic_source") -> DataFrame:
    """The funnel and source columns of the KPI row from one pass over per-source stage counts.

    Right where each unit has one source: the overall counts are then the sums.
    """
    rated = counts.withColumn("conversion_pct", pct(f"n{len(stages) - 1}", "n0", 2))
    one = rated.agg(*stage_totals(stages), *_source_part(source_col))
    names = [c for c in one.columns if not c.startswith("n") or not c[1:].isdigit()]
    return (long_rows(one, stages, keep=names)
            .agg(*_funnel_part(), *[F.first(c).alias(c) for c in names]))


def kpi_summary(funnel: DataFrame, sources: DataFrame | None, matrix: DataFrame, segments: DataFrame,
                orders: DataFrame, source_col: str = "traffic_source", value: str = "total_sale_price",
                top_tier: str = "VIP (>$400)", retention_month: int = 1) -> DataFrame:
    """One row:

    - ``overall_conversion_pct``: last stage's share of the first (O02, 1 digit);
    - ``worst_dropoff_stage``, ``worst_dropoff_pct``: largest drop-off (earliest on ties);
    - ``best_source``/``worst_source`` with ``*_conversion_pct``: highest and lowest
      conversion in O04 (sources without a rate are skipped; name breaks ties);
    - ``month{n}_retention_avg``: mean month-``n`` retention over the kept cohorts (O07);
    - ``top_tier_revenue_share_pct``: the top tier's share (O20), 0.0 when absent;
    - ``valid_orders``, ``valid_revenue``: count and revenue of ``orders`` (already valid).

    ``funnel`` and ``sources`` are the rows of O02 and O04; with ``sources=None``,
    ``funnel`` is the row of :func:`funnel_and_sources`, which reads events once.
    """
    f = funnel if sources is None else funnel.agg(*_funnel_part())
    m = matrix.agg(exact_mean(str(retention_month)).alias(f"month{retention_month}_retention_avg"))
    g = segments.agg(F.expr(f"coalesce(max(CASE WHEN segment = {lit(top_tier)} THEN revenue_share_pct END), 0.0D)")
                     .alias("top_tier_revenue_share_pct"))
    o = orders.agg(F.count(F.lit(1)).alias("valid_orders"),
                   F.expr(f"round(coalesce({total_sql(ident(value))}, 0.0D), 2)").alias("valid_revenue"))
    parts = [] if sources is None else [sources.agg(*_source_part(source_col))]
    # Each part is one row: its values enter as scalar subqueries (Spark merges
    # those over the same part into one), not as joins.
    extra = [part.select(c).scalar().alias(c) for part in (*parts, m, g, o) for c in part.columns]
    return f.select("*", *extra)
