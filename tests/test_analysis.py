"""End to end on canonical CSV tables: declared-schema scans, marts, export, KPI."""

import os
import tempfile

import pytest

from shopmetrics.plans import analysis
from shopmetrics.sources.readers import load_tables, read_table


def _write_csv_tables(base):
    files = {
        "users": ["user_id,age,gender,country,state,traffic_source,created_at",
                  "1,30,F,US,CA,Email,2023-01-01 00:00:00",
                  "2,40,M,UK,,Search,2023-01-02 00:00:00",
                  "3,50,F,US,NY,Search,2023-01-03 00:00:00"],
        "events": ["event_id,session_id,user_id,event_type,created_at,device_type,browser,traffic_source,uri,product_id",
                   "1,10,1,home,2023-01-05 10:00:00,mobile,Chrome,Email,/,",
                   "2,10,1,category,2023-01-05 10:01:00,mobile,Chrome,Email,/c,",
                   "3,10,1,product,2023-01-05 10:02:00.250000,mobile,Chrome,Email,/product/7,7.0",
                   "4,10,1,cart,2023-01-05 10:03:00,mobile,Chrome,Email,/cart,7.0",
                   "5,10,1,purchase,2023-01-05 10:04:00,mobile,Chrome,Email,/purchase,7",
                   "6,11,2,home,2023-01-06 10:00:00,desktop,Safari,Search,/,",
                   "7,12,3,home,2023-02-06 10:00:00,tablet,Safari,Search,/,",
                   "8,13,9,home,2023-02-07 10:00:00,tablet,Safari,Search,/,"],
        "orders": ["order_id,user_id,status,num_of_item,total_sale_price,created_at,traffic_source",
                   "100,1,Complete,1,42.5,2023-01-05 10:04:00,Email",
                   "101,1,Shipped,2,60.0,2023-02-10 09:00:00,Email",
                   "102,2,Cancelled,1,15.0,2023-01-06 10:05:00,Search"],
        "order_items": ["order_item_id,order_id,user_id,product_id,status,sale_price,created_at,shipped_at,returned_at",
                        "1000,100,1,7,Complete,42.5,2023-01-05 10:04:00,2023-01-06 10:00:00,"],
        "products": ["product_id,product_name,category,brand,retail_price,cost,department",
                     "7,Tee,Tops,Acme,42.5,20.0,Women"],
    }
    for name, lines in files.items():
        with open(os.path.join(base, f"{name}.csv"), "w") as f:
            f.write("\n".join(lines) + "\n")


def test_declared_schema_scan(spark):
    base = tempfile.mkdtemp(prefix="canon-")
    _write_csv_tables(base)
    t = load_tables(spark, base, "csv", views=True)
    ev = t["events"]
    assert dict(ev.dtypes)["created_at"] == "timestamp_ntz" and dict(ev.dtypes)["product_id"] == "bigint"
    assert ev.where("product_id IS NULL").count() == 5   # home x4 and category
    assert {r[0] for r in ev.select("product_id").distinct().collect()} == {None, 7}   # 7.0 reads as 7
    assert t["users"].where("state IS NULL").count() == 1
    assert spark.sql("SELECT count(*) FROM orders").first()[0] == 3   # views registered


def test_run_writes_marts_and_kpi(spark):
    base = tempfile.mkdtemp(prefix="canon-")
    _write_csv_tables(base)
    out = tempfile.mkdtemp(prefix="marts-")
    written = analysis.run(spark, base, out, "csv", "csv")
    assert {"funnel_overall", "funnel_by_source", "cohort_retention", "monthly_trend", "customer_segments",
            "quality_nulls", "quality_orphans", "kpi_summary"} <= set(written)
    kpi = spark.read.option("header", True).option("inferSchema", True).csv(written["kpi_summary"]).first()
    assert kpi["overall_conversion_pct"] == 25.0      # home users 1, 2, 3, 9; buyer 1
    assert kpi["best_source"] == "Email" and kpi["worst_source"] == "Search"
    assert kpi["valid_orders"] == 2 and abs(kpi["valid_revenue"] - 102.5) < 1e-9
    orphans = spark.read.option("header", True).csv(written["quality_orphans"]).first()
    assert orphans["orphaned_event_rows"] == "1"
    trend = spark.read.option("header", True).csv(written["monthly_trend"]).collect()
    assert [r["month_str"] for r in trend] == ["2023-01", "2023-02"]


def test_run_with_parquet_output(spark):
    base = tempfile.mkdtemp(prefix="canon-")
    _write_csv_tables(base)
    out = tempfile.mkdtemp(prefix="marts-")
    written = analysis.run(spark, base, out, "csv", "parquet")
    kpi = spark.read.parquet(written["kpi_summary"]).first()
    assert kpi["overall_conversion_pct"] == 25.0 and kpi["valid_orders"] == 2
    seg = spark.read.parquet(written["customer_segments"])
    assert dict(seg.dtypes)["customers"] == "bigint" and seg.count() == 1   # user 1 only: 102.5, Mid


def test_fractional_ids_fail(spark):
    base = tempfile.mkdtemp(prefix="canon-")
    _write_csv_tables(base)
    with open(os.path.join(base, "products.csv"), "w") as f:
        f.write("product_id,product_name,category,brand,retail_price,cost,department\n7.5,Tee,Tops,Acme,1.0,1.0,Women\n")
    products = read_table(spark, f"{base}/products.csv", "products", "csv")
    assert products.select("product_name").first()[0] == "Tee"
    with pytest.raises(Exception, match="not a whole number"):
        products.select("product_id").collect()


def test_no_views_unless_asked_and_parquet_gets_declared_types(spark):
    base = tempfile.mkdtemp(prefix="canon-")
    spark.catalog.dropTempView("products")
    spark.sql("SELECT 7 AS product_id, 'Tee' AS product_name, 'Tops' AS category, 'Acme' AS brand, "
              "CAST(1 AS FLOAT) AS retail_price, 1.0D AS cost, 'Women' AS department"
              ).write.parquet(f"{base}/products.parquet")
    t = load_tables(spark, base, "parquet", names=("products",))
    assert dict(t["products"].dtypes)["product_id"] == "bigint" and dict(t["products"].dtypes)["retail_price"] == "double"
    assert not spark.catalog.tableExists("products")
