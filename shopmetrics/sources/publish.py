"""Versioned publication of result marts: readers see a whole set, the former one or the new one.

Every run writes into a folder of its own, ``{path}/runs/{run}``, and nothing there
is ever overwritten. When all marts are written, one row - the manifest - is added
to ``{path}/manifests`` as a single file; Spark's committer makes it visible in one
step. Readers follow the newest manifest. A run that dies before that leaves a
folder that no manifest names. Everything goes through Spark's readers and
writers, so any store that Spark knows will do.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.sources.sinks import export_marts

MANIFEST = "version BIGINT, run STRING, published_at TIMESTAMP, format STRING, marts MAP<STRING, STRING>"


@dataclass(frozen=True)
class Publication:
    """One published set: its version, the run that wrote it, format and folder of each mart."""

    version: int
    run: str
    format: str
    marts: dict[str, str]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """One mart of this set."""
        reader = spark.read.option("header", True).option("multiLine", True) if self.format == "csv" else spark.read
        return reader.format(self.format).load(self.marts[name])


def new_run(path: str) -> str:
    """The folder of a run yet to be written."""
    return f"{path.rstrip('/')}/runs/{uuid.uuid4().hex}"


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def publish(spark: SparkSession, path: str, run: str, marts: dict[str, str], fmt: str) -> Publication:
    """Make the written marts of a run folder the newest set of ``path``.

    Of two runs that publish at once, both sets are whole and the later one is the newest.
    """
    base = path.rstrip("/") + "/"
    if not run.startswith(base) or not all(p.startswith(run) for p in marts.values()):
        raise ValueError("marts must lie in the run's folder, and that under the publication's")
    version = (_manifests(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    row = spark.range(1).select(
        F.lit(version).cast("long").alias("version"), F.lit(run.rsplit("/", 1)[1]).alias("run"),
        F.current_timestamp().alias("published_at"), F.lit(fmt).alias("format"),
        F.create_map(*[F.lit(x) for k, p in marts.items() for x in (k, p.removeprefix(base))]).alias("marts"))
    row.coalesce(1).write.mode("append").json(f"{base}manifests")
    return Publication(version, run.rsplit("/", 1)[1], fmt, dict(marts))


def publish_marts(frames: dict[str, DataFrame], path: str, fmt: str = "parquet", single_file: bool = False) -> Publication:
    """Write all frames into a new run's folder, then publish them together."""
    spark, run = next(iter(frames.values())).sparkSession, new_run(path)
    return publish(spark, path, run, export_marts(frames, run, fmt, single_file, mode="errorifexists"), fmt)


def _publication(row, path: str) -> Publication:
    base = path.rstrip("/")
    return Publication(row["version"], row["run"], row["format"], {k: f"{base}/{p}" for k, p in row["marts"].items()})


def published(spark: SparkSession, path: str, version: int | None = None) -> Publication | None:
    """The newest published set of ``path``, or that of a version; None where there is none."""
    rows = _manifests(spark, path)
    rows = rows if version is None else rows.where(F.col("version") == version)
    found = rows.orderBy(F.desc("version"), F.desc("published_at"), F.desc("run")).limit(1).collect()
    return _publication(found[0], path) if found else None


def expired(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Run folders of all published sets but the newest ``keep``, for the caller to delete."""
    rows = _manifests(spark, path).select("version", "published_at", "run").orderBy(
        F.desc("version"), F.desc("published_at"), F.desc("run")).collect()
    return [f"{path.rstrip('/')}/runs/{r['run']}" for r in rows[keep:]]
