"""The full analysis as one Spark job: canonical tables in, result marts out.

This is the reference's analysis script re-expressed: the data-quality
report, the five export marts (funnel, funnel by source, cohort matrix,
monthly trend, customer segments) and the KPI summary.

Every run writes into a folder of its own under the output folder and publishes it
with one manifest at the end (``sources.publish``), so readers never see marts of
two runs mixed. Text input is parsed once: the tables are written as Parquet
(``tables/``), audited on the way (``sources.convert``), and everything reads those,
pruned and pushed down; bad rows stop the run or are set aside and counted. Each
mart is written once, as Parquet with its types; the KPI summary is computed from the
*written* marts (a few rows each) plus one aggregate over valid orders. CSV copies of the marts for
other tools are made from the written marts, as one file each if asked.

    python -m shopmetrics.plans.analysis INPUT_DIR OUTPUT_DIR [--in-format csv] [--out-format csv]
        [--single-file] [--bad-records quarantine] [--input-bytes N --cores N]

``INPUT_DIR`` holds ``users``, ``events``, ``orders``, ``order_items`` and
``products`` as ``{name}.{format}`` (a file or a folder of part files).
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from shopmetrics.operators import cohort, funnel, quality, revenue, segments, summary
from shopmetrics.session import scale_conf
from shopmetrics.schemas import TABLES
from shopmetrics.sources.convert import bad_record_counts, convert_csv, observed_counts
from shopmetrics.sources.publish import new_run, publish
from shopmetrics.sources.readers import load_tables
from shopmetrics.sources.sinks import export_marts

AUDITED = ("events", "users", "orders")


def analysis_marts(events: DataFrame, orders: DataFrame, unit: str = "user_id",
                   stages: Sequence[str] = funnel.DEFAULT_STAGES,
                   labels: Sequence[str] | None = funnel.DEFAULT_LABELS,
                   status_in: Sequence[str] = cohort.VALID_STATUSES) -> dict[str, DataFrame]:
    """The five export marts, lazily (names as the reference's export files)."""
    return {
        "funnel_overall": funnel.funnel_long(events, unit, stages, labels),
        "funnel_by_source": funnel.funnel_by_compact(events, "traffic_source", unit, stages),
        "cohort_retention": cohort.cohort_matrix(cohort.cohort_retention(orders, status_in=status_in)),
        "monthly_trend": revenue.revenue_trend_export(events, orders, visit_event=stages[0],
                                                      status_in=status_in),
        "customer_segments": segments.spend_segments(orders, status_in=status_in),
    }


def quality_report(tables: dict[str, DataFrame], counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The data-quality section: null audit and row counts, duplicate pairs, orphans, outliers.

    Null and row counts come from ``counts`` (see ``quality.null_and_row_counts``):
    given where they are known, else one aggregate per table.
    """
    ev, od, us = tables["events"], tables["orders"], tables["users"]
    counts = quality.null_and_row_counts(tables, AUDITED) if counts is None else counts
    return {
        "quality_nulls": quality.nulls_of(counts),
        "quality_duplicates": quality.duplicate_key_count(ev),
        "quality_orphans": quality.orphan_count(ev, us),
        "quality_outliers": quality.outlier_summary(od),
        "row_counts": quality.row_counts_of(counts),
    }


def ingest(spark: SparkSession, input_dir: str, run_dir: str, in_format: str, bad_records: str = "fail",
           ) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The canonical tables, and what is known of them as marts: ``quality_counts`` and, for CSV, bad records.

    CSV is converted once and counted while it is written; Parquet is read as
    given and counted by one aggregate per table, which the caller writes once.
    """
    if in_format != "csv":
        tables = load_tables(spark, input_dir, in_format)
        return tables, {"quality_counts": quality.null_and_row_counts(tables, AUDITED)}
    found = [convert_csv(spark, f"{input_dir.rstrip('/')}/{name}.csv", f"{run_dir}/tables/{name}.parquet", name, bad_records)
             for name in TABLES]
    marts = {"quality_counts": observed_counts(spark, found, AUDITED), "quality_bad_records": bad_record_counts(spark, found)}
    bad = [c.bad.selectExpr(f"'{c.name}' AS table_name", "*") for c in found if c.bad_rows]
    for k, rows in enumerate(bad):
        marts["bad_records"] = rows if k == 0 else marts["bad_records"].unionByName(rows)
    return {c.name: c.table for c in found}, marts


def run(spark: SparkSession, input_dir: str, output_dir: str, in_format: str = "csv",
        out_format: str = "csv", single_file: bool = False, bad_records: str = "fail") -> dict[str, str]:
    """Load, compute and write every mart, then the KPI summary from the written marts, then publish them.

    Returns the folder of each mart in ``out_format``; ``sources.publish.published``
    finds them again. With ``single_file``, each mart is one part file.
    """
    run_dir = new_run(output_dir)
    typed = run_dir if out_format == "parquet" else f"{run_dir}/marts"
    whole = single_file and out_format == "parquet"
    written: dict[str, str] = {}
    back: dict[str, DataFrame] = {}

    def write(marts: dict[str, DataFrame]) -> None:
        written.update(export_marts(marts, typed, fmt="parquet", single_file=whole, mode="errorifexists"))
        back.update({name: spark.read.schema(df.schema).parquet(written[name]) for name, df in marts.items()})

    tables, known = ingest(spark, input_dir, run_dir, in_format, bad_records)
    write(known)
    write({**quality_report(tables, back["quality_counts"]), **analysis_marts(tables["events"], tables["orders"])})
    write({"kpi_summary": summary.kpi_summary(
        back["funnel_overall"], back["funnel_by_source"], back["cohort_retention"], back["customer_segments"],
        cohort.valid_orders(tables["orders"]))})
    out = written if out_format == "parquet" else export_marts(back, run_dir, out_format, single_file, mode="errorifexists")
    return publish(spark, output_dir, run_dir, out, out_format).marts


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    ap.add_argument("input_dir")
    ap.add_argument("output_dir")
    ap.add_argument("--in-format", default="csv")
    ap.add_argument("--out-format", default="csv")
    ap.add_argument("--single-file", action="store_true", help="one part file per mart (marts are small)")
    ap.add_argument("--bad-records", choices=("fail", "quarantine"), default="fail",
                    help="what to do with CSV rows that the schema cannot take")
    ap.add_argument("--input-bytes", type=int, help="size of the input, to size shuffle partitions by")
    ap.add_argument("--cores", type=int, default=8, help="cores of the cluster, with --input-bytes")
    args = ap.parse_args(argv)
    builder = SparkSession.builder.appName("shopmetrics-analysis").config("spark.sql.session.timeZone", "UTC")
    if args.input_bytes:
        builder = builder.config(map=scale_conf(args.input_bytes, args.cores))
    spark = builder.getOrCreate()
    for name, path in run(spark, args.input_dir, args.output_dir, args.in_format, args.out_format,
                          args.single_file, args.bad_records).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
