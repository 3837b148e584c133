"""CSV conversion: bad rows set aside, counts observed on the way, figures equal the scans'."""

import os

import pytest

from shopmetrics.operators import quality
from shopmetrics.plans import analysis
from shopmetrics.sources.convert import convert_csv
from shopmetrics.sources.readers import load_tables
from tests.test_analysis import _write_csv_tables

BAD = ["104,5,Complete,1,12.0,never,Email", "105.5,5,Complete,1,12.0,2023-01-09 10:00:00,Email", "106,5,Complete,1"]


def _tables(tmp_path, bad=()):
    base = str(tmp_path / "in")
    os.makedirs(base)
    _write_csv_tables(base)
    with open(f"{base}/orders.csv", "a") as f:
        f.write("".join(x + "\n" for x in bad))
    return base


def test_three_bad_rows(spark, tmp_path):
    base = _tables(tmp_path, BAD)
    got = convert_csv(spark, f"{base}/orders.csv", f"{tmp_path}/orders.parquet", "orders", "quarantine")
    assert (got.rows, got.bad_rows) == (3, 3)
    assert sorted(r["order_id"] for r in got.table.collect()) == [100, 101, 102]
    assert got.table.dtypes == load_tables(spark, base, "csv", ("orders",))["orders"].dtypes
    bad = {r["reason"]: r for r in got.bad.where("reason LIKE '%whole%'").collect()}
    assert bad["order_id: not a whole number"]["record"].startswith("105.5,5,Complete,1,12.0")
    lines = sorted(r["record"] for r in got.bad.where("reason = 'malformed row'").collect())
    assert lines == [BAD[0], BAD[2]]
    assert all(r["file"].endswith("orders.csv") for r in got.bad.collect())
    assert sum(got.nulls.values()) == 0


def test_failing_is_the_default(spark, tmp_path):
    base = _tables(tmp_path, BAD[:1])
    with pytest.raises(Exception):
        convert_csv(spark, f"{base}/orders.csv", f"{tmp_path}/a.parquet", "orders")
    with pytest.raises(ValueError):
        convert_csv(spark, f"{base}/orders.csv", f"{tmp_path}/b.parquet", "orders", "ignore")


def test_numbers_too_large_and_a_file_of_bad_rows_only(spark, tmp_path):
    head = "product_id,product_name,category,brand,retail_price,cost,department\n"
    for name, text in (("big", head + "99999999999999999999,Tee,Tops,A,1.0,1.0,W\n7.0,Tee,Tops,A,1.0,1.0,W\n"),
                       ("bad", head + "x,Tee,Tops,A,1.0,1.0,W\n"), ("none", head)):
        with open(tmp_path / f"{name}.csv", "w") as f:
            f.write(text)
    got = {n: convert_csv(spark, f"{tmp_path}/{n}.csv", f"{tmp_path}/{n}.parquet", "products", "quarantine")
           for n in ("big", "bad", "none")}
    assert {n: (c.rows, c.bad_rows) for n, c in got.items()} == {"big": (1, 1), "bad": (0, 1), "none": (0, 0)}
    assert [r["product_id"] for r in got["big"].table.collect()] == [7]
    assert got["bad"].table.count() == 0 and got["none"].table.count() == 0 and got["none"].bad.count() == 0


@pytest.mark.parametrize("bad_records", ["fail", "quarantine"])
def test_observed_counts_equal_the_audits(spark, tmp_path, bad_records):
    base = _tables(tmp_path)
    found = {n: convert_csv(spark, f"{base}/{n}.csv", f"{tmp_path}/{n}.parquet", n, bad_records) for n in analysis.TABLES}
    tables = {n: c.table for n, c in found.items()}
    assert {r[0]: r[1] for r in quality.row_counts(tables).collect()} == {n: c.rows for n, c in found.items()}
    for n, c in found.items():
        audit = {r["column_name"]: r["null_count"] for r in quality.null_audit(c.table, n).collect()}
        assert audit == {k: v for k, v in c.nulls.items() if v}
    assert load_tables(spark, base, "csv")["events"].collect() == tables["events"].collect()


def test_the_analysis_survives_bad_rows_and_reports_them(spark, tmp_path):
    clean, dirty = _tables(tmp_path / "a"), _tables(tmp_path / "b", BAD)
    want = analysis.run(spark, clean, str(tmp_path / "out-a"), "csv", "parquet")
    got = analysis.run(spark, dirty, str(tmp_path / "out-b"), "csv", "parquet", bad_records="quarantine")
    for name in want:
        if name != "quality_bad_records":
            assert spark.read.parquet(got[name]).collect() == spark.read.parquet(want[name]).collect(), name
    counts = {r[0]: r[1] for r in spark.read.parquet(got["quality_bad_records"]).collect()}
    assert counts == {"users": 0, "events": 0, "orders": 3, "order_items": 0, "products": 0}
    assert spark.read.parquet(got["bad_records"]).where("table_name = 'orders'").count() == 3
    assert "bad_records" not in want


def test_parquet_input_is_counted_once(spark, tmp_path):
    base = _tables(tmp_path)
    for name, df in load_tables(spark, base, "csv").items():
        df.write.parquet(f"{tmp_path}/p/{name}.parquet")
    got = analysis.run(spark, f"{tmp_path}/p", str(tmp_path / "out"), "parquet", "parquet")
    text = analysis.run(spark, base, str(tmp_path / "out2"), "csv", "parquet")
    for name in ("quality_nulls", "row_counts"):
        a, b = (sorted(map(tuple, spark.read.parquet(x[name]).collect())) for x in (got, text))
        assert a == b and a, name
    plan = quality.nulls_of(spark.read.parquet(got["quality_counts"])).inputFiles()
    assert all("quality_counts" in f for f in plan)
