"""Column-level helpers shared by the operators (all Catalyst expressions)."""

from shopmetrics.functions.ratios import exact_mean, pct, safe_div, total
from shopmetrics.functions.time import month_offset, period_start, period_text

__all__ = [
    "exact_mean",
    "month_offset",
    "pct",
    "period_start",
    "period_text",
    "safe_div",
    "total",
]
