"""CSV to Parquet in one pass that also audits the table and sets bad rows aside.

The rows are parsed once. While they are written, their number, the NULLs of
every column and the number of bad rows are observed (``DataFrame.observe``), so
the quality report needs no scan of its own. A bad row is one that the declared
schema cannot take: malformed, or a fraction where a whole number belongs.

``bad_records="fail"`` stops at the first bad row. With ``"quarantine"`` bad rows go
to a partition of their own, with the line, the reason and the file; the others are the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, StringType, StructField, StructType

from shopmetrics.functions.sql import ident, lit
from shopmetrics.schemas import TABLES
from shopmetrics.sources.readers import TIMESTAMP_FORMAT, WHOLE, as_text_schema, read_table

RECORD, REASON, FILE, BAD = "_record", "_reason", "_file", "_bad"


@dataclass(frozen=True)
class Conversion:
    """A converted table, its bad rows (``record, reason, file``), and what was counted on the way."""

    name: str
    table: DataFrame
    bad: DataFrame
    rows: int
    bad_rows: int
    nulls: dict[str, int]


def _sorted_out(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The declared columns of every row, and for bad rows the line, the reason and the file."""
    declared = TABLES[name]
    raw = (spark.read.schema(as_text_schema(declared).add(RECORD, "string"))
           .option("header", True).option("timestampNTZFormat", TIMESTAMP_FORMAT)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD).csv(path))
    whole = {f.name: f.dataType.simpleString() for f in declared if isinstance(f.dataType, IntegralType)}

    def number(c: str) -> str:
        return f"CASE WHEN {ident(c)} RLIKE '{WHOLE}' THEN try_cast(split_part({ident(c)}, '.', 1) AS {whole[c]}) END"

    reasons = [f"WHEN {ident(RECORD)} IS NOT NULL THEN 'malformed row'"]
    reasons += [f"WHEN {ident(c)} IS NOT NULL AND ({number(c)}) IS NULL THEN {lit(c + ': not a whole number')}" for c in whole]
    line = f"to_csv(struct({', '.join(ident(f.name) for f in declared)}), map('timestampNTZFormat', 'yyyy-MM-dd HH:mm:ss'))"
    found = raw.withColumn(REASON, F.expr(f"CASE {' '.join(reasons)} END"))
    return found.selectExpr(
        *[f"{number(f.name)} AS {ident(f.name)}" if f.name in whole else ident(f.name) for f in declared],
        f"CASE WHEN {REASON} IS NOT NULL THEN coalesce({RECORD}, {line}) END AS {RECORD}", REASON,
        f"CASE WHEN {REASON} IS NOT NULL THEN input_file_name() END AS {FILE}", f"{REASON} IS NOT NULL AS {BAD}")


def convert_csv(spark: SparkSession, source: str, target: str, name: str, bad_records: str = "fail") -> Conversion:
    """Write the canonical table ``name`` from CSV ``source`` as Parquet at ``target``.

    A malformed row with a bad number counts once. An empty file gives an empty table.
    """
    if bad_records not in ("fail", "quarantine"):
        raise ValueError(f"bad_records must be 'fail' or 'quarantine', got {bad_records!r}")
    declared = TABLES[name]
    if bad_records == "fail":
        rows = read_table(spark, source, name, "csv").withColumns(
            {RECORD: F.lit(None).cast("string"), REASON: F.lit(None).cast("string"), FILE: F.lit(None).cast("string"),
             BAD: F.lit(False)})
    else:
        rows = _sorted_out(spark, source, name)
    seen = Observation()
    counts = [F.count_if(~F.col(BAD)).alias("rows"), F.count_if(F.col(BAD)).alias("bad")]
    counts += [F.count_if(~F.col(BAD) & F.col(f.name).isNull()).alias(f"null{i}") for i, f in enumerate(declared)]
    rows.observe(seen, *counts).write.partitionBy(BAD).parquet(target)
    got = seen.get
    stored = spark.read.schema(StructType([StructField(f.name, f.dataType) for f in declared] + [
        StructField(c, StringType()) for c in (RECORD, REASON, FILE)] + [StructField(BAD, BooleanType())])).parquet(target)
    return Conversion(
        name, stored.where(f"NOT {BAD}").select(*[f.name for f in declared]),
        stored.where(BAD).select(F.col(RECORD).alias("record"), F.col(REASON).alias("reason"), F.col(FILE).alias("file")),
        got["rows"], got["bad"], {f.name: got[f"null{i}"] for i, f in enumerate(declared)})


def observed_counts(spark: SparkSession, found: list[Conversion], audited: tuple[str, ...]) -> DataFrame:
    """What ``quality.null_and_row_counts`` gives, from the counts of the conversions."""
    rows = [(c.name, None, c.rows) for c in found]
    rows += [(c.name, column, n) for c in found if c.name in audited for column, n in c.nulls.items()]
    return spark.createDataFrame(rows, "table_name STRING, column_name STRING, n BIGINT")


def bad_record_counts(spark: SparkSession, found: list[Conversion]) -> DataFrame:
    """``table_name, bad_rows`` of every converted table."""
    return spark.createDataFrame([(c.name, c.bad_rows) for c in found], "table_name STRING, bad_rows BIGINT")
