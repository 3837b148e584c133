"""Intermediate tables in a folder that every executor sees.

Iterative operators write each round and read it again: the lineage ends there, and
a lost executor re-reads files instead of recomputing the rounds before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}  # folders of local sessions by application


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's path under ``spark.checkpoint.dir`` of the session.

    Only a local session that names no such folder gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        app = spark.sparkContext.applicationId
        base = _local.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="shopmetrics-tables-")
        _local[app] = base
    return f"{base.rstrip('/')}/shopmetrics-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a Parquet table of the folder, read again with its own schema."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
