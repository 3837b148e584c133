"""Written tables and the folder they lie in."""

import os

import pytest

from shopmetrics.llm import common, substrings
from tests.llm.data import DOCUMENTS, edge_rows


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Session:
    def __init__(self, **conf):
        self.conf = _Conf({k.replace("_", "."): v for k, v in conf.items()})
        self.sparkContext = type("C", (), {"applicationId": "app-test"})()


def test_the_sessions_folder_is_used():
    s = _Session(spark_checkpoint_dir="hdfs://x/y", spark_master="yarn")
    assert common.scratch_path(s, "t").startswith("hdfs://x/y/shopmetrics-t-")


def test_a_temporary_folder_only_in_local_sessions():
    local = _Session(spark_master="local[4]")
    assert common.shared_dir(local) == common.shared_dir(local) and common.shared_dir(local).startswith("file://")
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(_Session(spark_master=master))


def test_written_keeps_schema_and_rows(spark):
    df = spark.sql("SELECT 1L AS a, array(1, NULL) AS b, CAST(NULL AS STRING) AS c")
    again = common.written(df, "t")
    assert again.collect() == df.collect() and again.dtypes == df.dtypes
    assert common.written(df.limit(0), "t").count() == 0


def test_filter_rows_keeps_columns_and_treats_null_as_empty(spark):
    df = spark.createDataFrame([(1, "keep", [1.5]), (2, None, None), (3, "drop", [])], "id INT, text STRING, v ARRAY<DOUBLE>")
    assert common.filter_rows(df, "text", lambda t: t != "drop").collect() == df.where("id < 3").collect()
    assert common.filter_rows(df.limit(0), "text", bool).columns == df.columns


def test_a_scratch_run_leaves_nothing_behind(spark):
    outside = common.written(spark.range(3), "outside")
    docs = spark.createDataFrame(edge_rows(), DOCUMENTS)
    tables = {t.name for t in spark.catalog.listTables()}
    with common.scratch_run(spark) as folder:
        path = folder.removeprefix("file://")
        with common.scratch_run(spark) as inner:
            one = common.written(spark.range(5), "inner")
            assert one.count() == 5 and os.path.isdir(inner.removeprefix("file://"))
        assert not os.path.exists(inner.removeprefix("file://"))
        rows = substrings.remove_repeats(docs).collect()
        assert len(rows) == len(edge_rows()) and os.listdir(path)
    assert not os.path.exists(path)
    assert {t.name for t in spark.catalog.listTables()} == tables and outside.count() == 3
    with pytest.raises(ZeroDivisionError), common.scratch_run(spark) as failed:
        common.written(spark.range(2), "failed")
        1 / 0
    assert not os.path.exists(failed.removeprefix("file://"))
