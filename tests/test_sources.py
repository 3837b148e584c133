"""The declared schemas of the test tables match the files at every scale present."""

import os

import pytest
from pyspark.sql.types import _parse_datatype_string

from shopmetrics.sources.testdata import TEST_SCHEMAS

DIRS = [d for d in (f"/root/testdata/sf{s}" for s in ("0.001", "0.01", "0.1")) if os.path.isdir(d)]


@pytest.mark.skipif(not DIRS, reason="test tables not present")
@pytest.mark.parametrize("name", sorted(TEST_SCHEMAS))
def test_declared_schema_matches_files(spark, name):
    declared = [(f.name, f.dataType.simpleString()) for f in _parse_datatype_string(TEST_SCHEMAS[name])]
    for d in DIRS:
        inferred = [(f.name, f.dataType.simpleString())
                    for f in spark.read.parquet(f"{d}/{name}.parquet").schema]
        assert inferred == declared, d


@pytest.mark.parametrize("kind", ["DOUBLE", "FLOAT", "DECIMAL(5,1)", "STRING"])
def test_whole_numbers_of_parquet_are_not_cut_off(spark, tmp_path, kind):
    from shopmetrics.sources.readers import read_table

    rest = "'Tee' AS product_name, 'Tops' AS category, 'A' AS brand, 1.0D AS retail_price, 1.0D AS cost, 'W' AS department"
    for name, value in (("good", "7.0"), ("bad", "7.5")):
        spark.sql(f"SELECT CAST({value} AS {kind}) AS product_id, {rest} UNION ALL SELECT NULL, {rest}"
                  ).write.parquet(f"{tmp_path}/{name}")
    good = read_table(spark, f"{tmp_path}/good", "products").select("product_id")
    assert good.dtypes == [("product_id", "bigint")]
    assert sorted((r[0] for r in good.collect()), key=str) == [7, None]
    bad = read_table(spark, f"{tmp_path}/bad", "products")
    assert bad.select("product_name").count() == 2
    with pytest.raises(Exception, match="not a whole number"):
        bad.select("product_id").collect()


def test_infinite_ids_fail_and_nan_is_missing(spark, tmp_path):
    from shopmetrics.sources.readers import read_table

    rest = "'Tee' AS product_name, 'Tops' AS category, 'A' AS brand, 1.0D AS retail_price, 1.0D AS cost, 'W' AS department"
    for name, value in (("nan", "NaN"), ("inf", "Infinity")):
        spark.sql(f"SELECT DOUBLE('{value}') AS product_id, {rest}").write.parquet(f"{tmp_path}/{name}")
    assert read_table(spark, f"{tmp_path}/nan", "products").select("product_id").first()[0] is None
    with pytest.raises(Exception, match="not a whole number"):
        read_table(spark, f"{tmp_path}/inf", "products").select("product_id").collect()
