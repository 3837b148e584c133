"""Ratios and money arithmetic.

Spark 4 runs with ANSI mode on, where a division by zero raises even for
doubles, so every denominator goes through ``nullif(d, 0)``: a zero
denominator yields NULL, as ``NULLIF`` does in SQL.

Ratios are computed on doubles (``100.0D`` is a double), never on
decimals, so ``round`` returns a double and the result type does not depend
on the input's precision.

Amounts are summed unrounded. Values between ``EXACT_FROM`` and ``EXACT_TO``
in size are summed as ``DECIMAL(28,10)``, so a total does not depend on the
order rows arrive in; smaller and larger ones are summed as doubles beside
them, so none is lost and none overflows. NULL and NaN are missing values. A
total becomes a double once, at the end, and only a result column is rounded.

Given column names, the helpers return one SQL expression (``F.expr``):
Spark parses it in a single call, where the equivalent chain of Column
operators costs a round trip to the JVM per operator, which dominated query
set-up time on small inputs. Given Columns, they compose Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmetrics.functions.sql import ident, pct_sql

EXACT = "DECIMAL(28,10)"
EXACT_FROM, EXACT_TO = "1e-4D", "1e15D"  # 1e13 values of the largest size fit the sum's 38 digits


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double, NULL when ``den`` is 0 or NULL."""
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(f"CAST({ident(num)} AS DOUBLE) / nullif(CAST({ident(den)} AS DOUBLE), 0.0D)")
    return _col(num).cast("double") / F.nullif(_col(den).cast("double"), F.lit(0.0))


def pct(num: Column | str, den: Column | str, digits: int | None = 1) -> Column:
    """``round(100 * num / den, digits)``, half-up; NULL on a zero denominator.

    ``digits=None`` leaves the value unrounded.
    """
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(pct_sql(ident(num), ident(den), digits))
    ratio = F.lit(100.0) * _col(num).cast("double") / F.nullif(_col(den).cast("double"), F.lit(0.0))
    return ratio if digits is None else F.round(ratio, digits)


def present_sql(x: str) -> str:
    """SQL operand as a double, NULL where it is NULL or NaN."""
    return f"nanvl(CAST({x} AS DOUBLE), CAST(NULL AS DOUBLE))"


def total_sql(x: str) -> str:
    """Sum of a SQL operand as a double (see the module's text); NULL without any value."""
    v = present_sql(x)
    exact = f"abs({v}) >= {EXACT_FROM} AND abs({v}) < {EXACT_TO}"
    dec = f"sum(CASE WHEN {exact} THEN CAST({x} AS {EXACT}) END)"
    rest = f"sum(CASE WHEN NOT ({exact}) THEN {v} END)"
    return f"CASE WHEN {dec} IS NULL THEN {rest} ELSE CAST({dec} AS DOUBLE) + coalesce({rest}, 0.0D) END"


def total(c: str) -> Column:
    """Order-independent sum of a column's unrounded values, as double."""
    return F.expr(total_sql(ident(c)))


def exact_mean(c: str) -> Column:
    """Mean of a column's unrounded values, whatever order partial sums merge in; NULL without any."""
    q = ident(c)
    return F.expr(f"({total_sql(q)}) / nullif(CAST(count({present_sql(q)}) AS DOUBLE), 0.0D)")
