"""Scans of the canonical tables.

CSV is read with the declared schema (no inference pass over the data) and an
explicit timestamp format. Whole numbers are accepted as pandas writes them
from a column with missing values (``7.0``); any other fraction in such a
column is an error. Parquet columns are cast to the declared types where the
file holds others, under the same rule: a whole number may be stored as ``7.0``,
NaN is a missing one, and a fraction or an infinity in its place fails the
query. The result is lazy, so column pruning and filter pushdown reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, FractionalType, IntegralType, StringType, StructField, StructType

from shopmetrics.functions.sql import ident, lit
from shopmetrics.schemas import TABLES

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


WHOLE = "^[+-]?[0-9]+([.]0*)?$"  # a whole number as text


def _whole(name: str, kind: DataType) -> Column:
    """A text column as whole numbers; a text that is none fails the query."""
    c = ident(name)
    return _checked(name, f"{c} RLIKE '{WHOLE}'", f"split_part({c}, '.', 1)", kind)


def _checked(name: str, good: str, number: str, kind: DataType, missing: str = "") -> Column:
    c, to = ident(name), kind.simpleString()
    bad = f"raise_error(concat({lit(name + ': not a whole number: ')}, CAST({c} AS STRING)))"
    return F.expr(f"CASE WHEN {c} IS NULL{missing} THEN NULL WHEN {good} THEN CAST({number} AS {to}) "
                  f"ELSE CAST({bad} AS {to}) END").alias(name)


def _as_declared(name: str, held: DataType, declared: DataType) -> Column:
    """A stored column as its declared type; whole numbers are never made by cutting off a fraction."""
    c = ident(name)
    if held == declared:
        return F.col(name)
    if isinstance(declared, IntegralType) and isinstance(held, StringType):
        return _whole(name, declared)
    if isinstance(declared, IntegralType) and isinstance(held, DecimalType):
        return _checked(name, f"{c} = floor({c})", c, declared)
    if isinstance(declared, IntegralType) and isinstance(held, FractionalType):
        return _checked(name, f"{c} = floor({c})", c, declared, f" OR isnan({c})")
    return F.col(name).cast(declared).alias(name)


def as_text_schema(declared: StructType) -> StructType:
    """The schema that CSV is scanned with: whole numbers as text, to be checked."""
    return StructType([StructField(f.name, StringType() if isinstance(f.dataType, IntegralType) else f.dataType)
                       for f in declared])


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Read one canonical table from ``path`` (a file or a folder of part files)."""
    declared = TABLES[name]
    if fmt == "csv":
        raw = (spark.read.schema(as_text_schema(declared))
               .option("header", True)
               .option("timestampNTZFormat", TIMESTAMP_FORMAT)
               .option("mode", "FAILFAST")
               .csv(path))
        return raw.select(*[_whole(f.name, f.dataType) if isinstance(f.dataType, IntegralType) else F.col(f.name)
                            for f in declared])
    raw = spark.read.format(fmt).load(path)
    return raw.select(*[_as_declared(f.name, raw.schema[f.name].dataType, f.dataType) for f in declared])


def load_tables(spark: SparkSession, base: str, fmt: str = "csv", names: tuple[str, ...] = tuple(TABLES),
                views: bool = False) -> dict[str, DataFrame]:
    """Read ``{base}/{name}.{fmt}`` for each canonical table.

    With ``views``, a temporary view of each table's name is registered, so the
    tables can be queried with ``spark.sql``; it replaces a view of that name.
    """
    out = {}
    for n in names:
        df = read_table(spark, f"{base.rstrip('/')}/{n}.{fmt}", n, fmt)
        if views:
            df.createOrReplaceTempView(n)
        out[n] = df
    return out
