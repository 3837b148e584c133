"""O25 — export the result marts.

Each mart is written by Spark's own committer (task output is committed
atomically, so a lost executor only re-runs its tasks). CSV with a header is
the reference's interchange format; Parquet is the default, since it keeps
types. The marts are small aggregates; ``single_file`` folds each into one
part file for spreadsheet and BI tools and must only be used on such small
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_marts(frames: dict[str, DataFrame], path: str, fmt: str = "parquet",
                 single_file: bool = False, mode: str = "overwrite") -> dict[str, str]:
    """Write each frame to ``{path}/{name}``; returns name -> written folder."""
    written = {}
    for name, df in frames.items():
        out = f"{path.rstrip('/')}/{name}"
        w = (df.coalesce(1) if single_file else df).write.mode(mode)
        if fmt == "csv":
            w.option("header", True).csv(out)
        else:
            w.format(fmt).save(out)
        written[name] = out
    return written
