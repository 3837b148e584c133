"""Shared helpers: table access, written intermediate tables, Arrow maps, fits in one task."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROWS_AT_ONCE = 1000  # rows of a batch that are Python objects at one time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; read through Spark, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_dirs: dict[str, str] = {}  # by application, for local sessions without a shared folder


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the session is local, as in tests, a temporary
    folder takes its place; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="shopmetrics-")
    return _local_dirs[app]


_run: ContextVar[str | None] = ContextVar("scratch_run", default=None)


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside the block share a folder, removed at its end.

    Results are lazy and read those tables, so write them before the block
    ends. Bucketed tables (operator 12) leave their name in the catalog; it is
    dropped as well. Blocks may nest; a failure inside still clears the folder.
    """
    name = f"shopmetrics-run-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{name}"
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        for t in spark.catalog.listTables():
            if t.name.startswith("texts_") and f"/{name}/" in _location(spark, t.name):
                spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE FORMATTED `{name}`").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else ""


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_run.get() or shared_dir(spark)}/shopmetrics-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table of the shared folder: lineage ends here, and a
    lost executor re-reads files instead of recomputing what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did.

    Its folder joins the workers' ``PYTHONPATH``; on a cluster the package is
    installed on every node, or lies in a folder all nodes see.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str,
                ) -> DataFrame:
    """``mapInArrow`` for functions from one Arrow batch to columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                out = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow)

    return map_arrow(df, run, schema)


def filter_rows(df: DataFrame, text_col: str, keep: Callable[[str], bool]) -> DataFrame:
    """The rows whose text ``keep`` accepts, with all their columns; a null text is an empty one."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                kept = batch.filter(pa.array([keep(t) for t in texts(batch.column(at))], type=pa.bool_()))
                if kept.num_rows:
                    yield kept

    return map_arrow(df, run, df.schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; nulls become empty texts."""
    return ["" if t is None else t for t in column.to_pylist()]


def fit_in_task(sample: DataFrame, rows: int, fit: Callable[[pa.Table | None], object]) -> object:
    """Fit a model on at most ``rows`` rows of a sample, in one task of an executor.

    The driver sees the model alone. The bound keeps the task's memory the same
    however large the input is; an empty sample is fitted as None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(found)))])], ["model"])

    got = map_arrow(sample.limit(rows).coalesce(1), run, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else fit(None)


def arrays(column: pa.ChunkedArray, kind: str) -> list:
    """The rows of a list column as numpy arrays, without a Python object per element."""
    out = []
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b].astype(kind) for a, b in zip(offsets[:-1], offsets[1:])]
    return out
