"""Quoting for SQL expression strings.

Operators build their projections as SQL expressions (``selectExpr`` /
``F.expr``): Spark parses each in one call, where a chain of Column
operators costs a JVM round trip per operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ident(name: str) -> str:
    """A column name as a quoted SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def lit(value: str) -> str:
    """A Python string as a SQL string literal."""
    esc = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{esc}'"


def pct_sql(num: str, den: str, digits: int | None = 1) -> str:
    """``round(100 * num / den, digits)`` over SQL operands; NULL on a zero denominator."""
    ratio = f"100.0D * CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0.0D)"
    return ratio if digits is None else f"round({ratio}, {int(digits)})"


def one_row_per_key(lookup: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A dimension with one row per key, so that a join cannot multiply rows.

    Of rows that repeat a key, the least by ``columns`` stays. The aggregate is
    hash-partitioned by the key, which a sort-merge join on it reuses.
    """
    least = lookup.groupBy(key).agg(F.min(F.struct(*columns)).alias("_row"))
    return least.select(key, *[F.col("_row").getField(c).alias(c) for c in columns])
