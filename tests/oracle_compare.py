"""Run a registered Spark query and its DuckDB oracle, and compare them the
way the driver does: column names, column types, row count, and the rows as
an order-insensitive multiset (doubles compared after rounding)."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# DuckDB type names for the Spark types our results use.
SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


DIGITS = int(os.environ.get("ORACLE_DIGITS", "6"))  # negative: compare doubles exactly


def _norm(v, digits=None):
    digits = DIGITS if digits is None else digits
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if digits < 0 else round(v, digits)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)


def compare(spark, sf_dir: str, name: str, query, sql: str, con=None) -> list[str]:
    """Return a list of differences (empty when the results match)."""
    con = con or duck(sf_dir)
    df = query(spark, sf_dir)
    s_cols = df.columns
    s_types = [SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema]
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    problems = []
    if s_cols != d_cols:
        problems.append(f"{name}: columns {s_cols} != {d_cols}")
    if s_types != d_types:
        problems.append(f"{name}: types {s_types} != {d_types}")
    if len(s_rows) != len(d_rows):
        problems.append(f"{name}: rows {len(s_rows)} != {len(d_rows)}")
    a = sorted((tuple(_norm(v) for v in r) for r in s_rows), key=_key)
    b = sorted((tuple(_norm(v) for v in r) for r in d_rows), key=_key)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        problems.append(f"{name}: values differ, e.g. {diff}")
    return problems
