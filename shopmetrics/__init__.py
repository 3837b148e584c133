"""shopmetrics: online-shop analytics (funnels, cohorts, revenue, segments,
data quality) as plain ``DataFrame -> DataFrame`` functions on Spark.

Every operator is declared with built-in Spark expressions, joins,
aggregates and windows so Catalyst and AQE plan it; nothing is pulled to
the driver and no Python UDF runs in the hot path.
"""

from shopmetrics.operators.funnel import (
    DEFAULT_STAGES,
    funnel_by,
    funnel_by_compact,
    funnel_by_device,
    funnel_long,
    funnel_overall,
)
from shopmetrics.operators.cohort import cohort_average, cohort_matrix, cohort_retention
from shopmetrics.operators.quality import (
    duplicate_key_count,
    duplicate_keys,
    null_audit,
    null_audit_union,
    orphan_count,
    outlier_summary,
    population_profile,
    row_counts,
    stage_integrity,
    value_distribution,
    zscore_outliers,
)
from shopmetrics.operators.quantiles import exact_quantiles
from shopmetrics.operators.revenue import (
    order_rollup,
    revenue_trend,
    revenue_trend_export,
    trend_summary,
)
from shopmetrics.operators.segments import DEFAULT_BOUNDS, DEFAULT_LABELS as DEFAULT_TIER_LABELS, spend_segments
from shopmetrics.operators.summary import kpi_summary
from shopmetrics.operators.visitors import (
    distinct_users,
    merge_sets,
    number_users,
    period_sets,
    roll_up,
    visitors_by_grain,
)
from shopmetrics.sources.sinks import export_marts

__all__ = [
    "DEFAULT_STAGES",
    "DEFAULT_BOUNDS",
    "DEFAULT_TIER_LABELS",
    "cohort_average",
    "cohort_matrix",
    "cohort_retention",
    "distinct_users",
    "duplicate_key_count",
    "duplicate_keys",
    "exact_quantiles",
    "export_marts",
    "funnel_by",
    "funnel_by_compact",
    "funnel_by_device",
    "funnel_long",
    "funnel_overall",
    "kpi_summary",
    "merge_sets",
    "null_audit",
    "null_audit_union",
    "number_users",
    "order_rollup",
    "orphan_count",
    "outlier_summary",
    "period_sets",
    "population_profile",
    "revenue_trend",
    "revenue_trend_export",
    "roll_up",
    "row_counts",
    "spend_segments",
    "stage_integrity",
    "trend_summary",
    "value_distribution",
    "visitors_by_grain",
    "zscore_outliers",
]
