"""Versioned publication: readers see whole sets, whatever happens to a run."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from shopmetrics.plans import analysis
from shopmetrics.sources.publish import expired, new_run, publish, publish_marts, published
from tests.test_analysis import _write_csv_tables


def _frames(spark, n):
    return {"a": spark.range(n), "b": spark.range(n).select((F.col("id") * 2).alias("x"))}


def _values(spark, path):
    p = published(spark, path)
    return p.version, p.read(spark, "a").count(), sorted(r[0] for r in p.read(spark, "b").collect())


def test_newest_set_and_versions(spark, tmp_path):
    path = str(tmp_path / "out")
    assert published(spark, path) is None and expired(spark, path) == []
    first = publish_marts(_frames(spark, 2), path)
    assert _values(spark, path) == (1, 2, [0, 2])
    publish_marts(_frames(spark, 3), path + "/", fmt="csv", single_file=True)
    assert published(spark, path).version == 2 and published(spark, path).read(spark, "a").count() == 3
    assert published(spark, path, version=1) == first
    publish_marts(_frames(spark, 1), path)
    assert expired(spark, path, keep=2) == [f"{path}/runs/{first.run}"]
    assert published(spark, path, version=9) is None


def test_a_run_that_fails_between_two_marts_leaves_the_former_set(spark, tmp_path):
    path = str(tmp_path)
    publish_marts(_frames(spark, 2), path)
    bad = {"a": spark.range(5), "b": spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("x"))}
    with pytest.raises(Exception, match="lost"):
        publish_marts(bad, path)
    assert len(os.listdir(tmp_path / "runs")) == 2  # the first mart of the failed run is there
    assert _values(spark, path) == (1, 2, [0, 2])
    publish_marts(_frames(spark, 4), path)
    assert _values(spark, path) == (2, 4, [0, 2, 4, 6])


def test_a_run_killed_between_two_marts_leaves_the_former_set(spark, tmp_path):
    path = str(tmp_path)
    publish_marts(_frames(spark, 2), path)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import os, sys; sys.path.insert(0, {root!r})\n"
            "from shopmetrics.session import local_session\nfrom shopmetrics.sources import publish\n"
            "s = local_session(cores=2)\n"
            "class Dies:\n    sparkSession = s\n    @property\n    def write(self): os._exit(9)\n"
            f"publish.publish_marts({{'a': s.range(7), 'b': Dies()}}, {path!r})\n")
    done = subprocess.run([sys.executable, "-c", code], timeout=300, capture_output=True)
    assert done.returncode == 9, done.stderr[-2000:]
    assert len(os.listdir(tmp_path / "runs")) == 2
    assert _values(spark, path) == (1, 2, [0, 2])


def test_marts_outside_the_run_are_refused(spark, tmp_path):
    run = new_run(str(tmp_path))
    with pytest.raises(ValueError):
        publish(spark, str(tmp_path), run, {"a": "/elsewhere/a"}, "parquet")
    with pytest.raises(ValueError):
        publish(spark, "/elsewhere", run, {"a": run + "/a"}, "parquet")


def test_the_analysis_publishes_its_marts(spark, tmp_path):
    base, out = tmp_path / "in", str(tmp_path / "out")
    base.mkdir()
    _write_csv_tables(str(base))
    first = analysis.run(spark, str(base), out, "csv", "parquet")
    assert published(spark, out).marts == first
    with open(base / "orders.csv", "a") as f:
        f.write("103,3,Complete,1,1.0,not a time,Search\n")
    with pytest.raises(Exception):
        analysis.run(spark, str(base), out, "csv", "parquet")
    assert published(spark, out).marts == first  # and they can still be read
    assert published(spark, out).read(spark, "kpi_summary").first()["valid_orders"] == 2
