"""Session helpers.

Library functions never create or reconfigure a session: they take
DataFrames. These helpers are for scripts, tests and the benchmark.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the operators are planned for. AQE re-plans joins from runtime
# sizes, coalesces small shuffle partitions and splits skewed ones.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def scale_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for a given input volume (a starting point for cluster jobs).

    The shuffle partition count is chosen so that, before AQE coalesces
    them, shuffle partitions hold about ``partition_bytes`` of input each (and
    at least two waves of tasks), which keeps hash aggregates and sorts
    within executor memory instead of spilling; scans are split at the same
    size. AQE then merges small partitions and splits skewed ones at runtime.
    """
    partitions = max(2 * total_cores, -(-int(input_bytes) // partition_bytes))
    return {
        **{k: v for k, v in RECOMMENDED_CONF.items() if k != "spark.ui.enabled"},
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "shopmetrics",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks (not for cluster use)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(RECOMMENDED_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("SHOPMETRICS_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
