"""Cohort retention kept up to date from new orders alone (O06 between runs).

Two tables lie under ``path``: ``members``, partitioned by cohort month, holds
the distinct months in which each user of the cohort ordered; ``cells`` gets a row of counts
per changed cohort and run, of which the newest of a cohort holds. New orders are reduced to distinct user months; only users among them can
change. A late order may move a user to an earlier cohort. The cohorts that
gain, lose or hold such a user are rewritten, all others stay as they are
(dynamic partition overwrite). Earlier orders are never read again.

Adding the same orders twice changes nothing. Counts are appended before members are
replaced, so a run that died before or between these two is simply repeated; one that
died while partitions were being replaced may have lost earlier months of moved users, and
the state is built anew. A cohort that lost its last user keeps a row without user, which no
reader counts; it makes Spark overwrite the partition. Orders can be added, not taken back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shopmetrics.operators.cohort import VALID_STATUSES, cohort_counts, order_months, retention_cells
from shopmetrics.sources.scratch import scratch_folder, written


class CohortState:
    """Stored cohorts under ``path``; arguments as those of ``cohort.cohort_retention``."""

    def __init__(self, spark: SparkSession, path: str, user: str = "user_id", ts: str = "created_at",
                 status: str | None = "status", status_in: Sequence[str] = VALID_STATUSES, horizon: int = 12) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.user, self.ts, self.status, self.status_in, self.horizon = user, ts, status, tuple(status_in), horizon

    def _stored(self, name: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _replace_members(self, df: DataFrame) -> None:
        # rebalance: small cohorts share a task, a cohort with a large share of all users is split
        (df.hint("rebalance", "cohort_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("cohort_month").parquet(f"{self.path}/members"))

    def _cells(self) -> DataFrame:
        counts = ", ".join(f"c{m} BIGINT" for m in range(self.horizon))
        return self._stored("cells", StructType.fromDDL(f"cohort_month TIMESTAMP_NTZ, {counts}, run BIGINT"))

    def members(self, kind: str = "BIGINT") -> DataFrame:
        """``(_user, order_month, cohort_month)``, a row per user and month with a valid order."""
        return self._stored("members", StructType.fromDDL(
            f"_user {kind}, order_month TIMESTAMP_NTZ, cohort_month TIMESTAMP_NTZ")).where("_user IS NOT NULL")

    def add(self, orders: DataFrame) -> int:
        """Take new orders in; returns the number of cohorts rewritten."""
        folder = scratch_folder(self.spark)
        new = order_months(orders, self.user, self.ts, self.status, self.status_in).select(
            F.col(self.user).alias("_user"), F.col("order_month").cast("timestamp_ntz").alias("order_month"))
        new = written(new, folder, "new")
        stored = self.members(new.schema["_user"].dataType.simpleString())
        users = new.select("_user").distinct()
        before = written(stored.join(users, "_user", "left_semi"), folder, "before")
        months = before.select("_user", "order_month").unionByName(new).distinct()
        after = written(months.selectExpr("_user", "order_month", "min(order_month) OVER (PARTITION BY _user) AS cohort_month"),
                        folder, "after")
        cohorts = written(before.select("cohort_month").unionByName(after.select("cohort_month")).distinct(), folder, "cohorts")
        # the other members of the cohorts that change; a cohort per row on the right
        others = stored.join(F.broadcast(cohorts), "cohort_month", "left_semi").join(users, "_user", "left_anti")
        empty = cohorts.select(F.lit(None).cast(new.schema["_user"].dataType).alias("_user"),
                               F.lit(None).cast("timestamp_ntz").alias("order_month"), "cohort_month")
        now = written(after.unionByName(others.select(after.columns)).unionByName(empty), folder, "now")
        counts = cohort_counts(now.where("_user IS NOT NULL"), self.horizon)
        cells = self._cells()
        run = (cells.agg(F.max("run")).first()[0] or 0) + 1
        (cohorts.join(counts, "cohort_month", "left").withColumn("run", F.lit(run).cast("long"))
         .select(cells.columns).coalesce(1).write.mode("append").parquet(f"{self.path}/cells"))
        self._replace_members(now)
        return cohorts.count()

    def retention(self) -> DataFrame:
        """The rows of O06, from the stored counts: neither orders nor members are read."""
        counts = [f"c{m}" for m in range(self.horizon)]
        cells = (self._cells().groupBy("cohort_month").agg(F.max_by(F.struct(*counts), "run").alias("newest"))
                 .select("cohort_month", "newest.*"))
        return retention_cells(cells.where("c0 > 0"), self.horizon)
