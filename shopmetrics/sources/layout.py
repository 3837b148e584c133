"""A stored layout for repeated runs: tables bucketed by user and partitioned by month.

Cohorts and funnels group by user, and joins of events, orders and users meet on
it. Stored in buckets of the user, these tables are read already dealt out: the
large side is not shuffled again. A range of months reads only its partitions.
Every bucket of a month is one file. As in any table bucketed by one column, a user
with a large share of all rows has them in one bucket: the operators reduce such
rows while they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.time import period_start

MONTH = "month"


def store_by_user(df: DataFrame, table: str, path: str, buckets: int, user: str = "user_id",
                  ts: str | None = "created_at") -> DataFrame:
    """Store ``df`` as ``table`` (files under ``path``) in ``buckets`` of ``user``, by month of ``ts``; returns the table.

    The month is a column ``month`` (a date; NULL where there is no time). With
    ``ts=None`` there are no partitions, as for users. Tables that are to meet
    without a shuffle need the same number of buckets. An existing table is replaced.
    """
    if ts is not None:
        if MONTH in df.columns:
            raise ValueError(f"the table has a column {MONTH!r} of its own")
        df = df.withColumn(MONTH, F.to_date(period_start(df, ts, "month")))
    writer = df.repartition(buckets, user).write.mode("overwrite").option("path", path).bucketBy(buckets, user)
    (writer if ts is None else writer.partitionBy(MONTH)).saveAsTable(table)
    return df.sparkSession.table(table)


def between_months(stored: DataFrame, first: str, last: str) -> DataFrame:
    """The rows from month ``first`` to month ``last`` (``yyyy-MM``), which are the only ones read."""
    return stored.where(F.col(MONTH).between(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01"))))
