"""Plan checks: the physical shapes the operators are designed for."""

import os

import pytest

import __spark_entry__ as entry
from shopmetrics.plans.inspect import count_nodes, has_python, node_names, physical_plan, raw_shuffles

SF = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


# the training-data operators use Python in tasks and have tests of their own
NAMES = sorted(set(entry.queries()) - set(entry.LLM_QUERIES))


def _q(spark, name):
    return entry.queries()[name](spark, SF)


@pytest.mark.parametrize("name", NAMES)
def test_no_python_in_any_plan(spark, name):
    assert not has_python(_q(spark, name))


def test_funnels_have_no_expand(spark):
    for name in ("funnel_overall", "funnel_by_source", "funnel_by_source_compact", "funnel_by_device",
                 "funnel_long"):
        assert "Expand" not in node_names(_q(spark, name)), name


def test_funnel_prunes_and_pushes_down(spark):
    text = physical_plan(_q(spark, "funnel_overall"))
    pushed = next(line for line in text.splitlines() if line.startswith("PushedFilters:"))
    assert "In(event_type, [click,purchase,signup,view])" in pushed
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text


def test_source_join_sees_aggregated_rows(spark):
    names = node_names(_q(spark, "funnel_by_source"))
    join = next(i for i, n in enumerate(names) if n.endswith("Join"))
    # the events side of the join is an aggregate, not a scan
    assert "HashAggregate" in names[join + 1:join + 3]


def test_orphans_plan_an_anti_join_on_keys(spark):
    text = physical_plan(_q(spark, "orphan_count"))
    assert "LeftAnti" in text


def test_duplicates_use_top_k(spark):
    assert count_nodes(_q(spark, "duplicate_keys"), "TakeOrderedAndProject") == 1


def test_trend_filters_reach_the_scan(spark):
    text = physical_plan(_q(spark, "revenue_trend_hourly"))
    assert any(line.startswith("PushedFilters:") and "EqualTo(event_type,view)" in line
               for line in text.splitlines())


def test_trend_copies_no_rows(spark):
    for name in ("revenue_trend_hourly", "revenue_trend_monthly", "revenue_trend_export", "trend_summary"):
        assert "Expand" not in node_names(_q(spark, name)), name


def test_outliers_scan_their_table_twice():
    # once for mean and deviation together, once for the rows; the sort samples dealt-out outliers
    import glob
    import json
    import subprocess
    import sys
    import tempfile

    logs = tempfile.mkdtemp(prefix="events-")
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from shopmetrics.session import local_session\nimport __spark_entry__ as e\n"
            "s = local_session(cores=2, extra={'spark.eventLog.enabled': 'true', "
            f"'spark.eventLog.compress': 'false', 'spark.eventLog.dir': 'file://{logs}'}})\n"
            f"e.queries()['zscore_outliers'](s, {SF!r}).collect()\ns.stop()\n")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    read = 0
    for path in glob.glob(f"{logs}/**/*", recursive=True):
        if os.path.isfile(path) and not os.path.basename(path).startswith("."):
            for line in open(path, errors="replace"):
                if '"SparkListenerTaskEnd"' in line:
                    read += json.loads(line)["Task Metrics"]["Input Metrics"]["Records Read"]
    assert read == 2 * 10_000


def test_cohort_has_no_distinct_count(spark):
    assert "Expand" not in node_names(_q(spark, "cohort_retention"))


def test_global_values_are_scalar_subqueries_not_joins(spark):
    for name in ("zscore_outliers", "outlier_summary", "event_type_share", "population_profile", "kpi_summary"):
        text = physical_plan(_q(spark, name))
        assert "Subquery" in text and "NestedLoopJoin" not in text and "CartesianProduct" not in text, name


# zscore_outliers sorts its outliers globally: those rows are shuffled as they
# are, but by Chebyshev at most 1/k^2 (1/9) of the input has |z| > k.
RAW_SHUFFLE_ALLOWED = {"zscore_outliers"}


@pytest.mark.parametrize("name", sorted(set(NAMES) - RAW_SHUFFLE_ALLOWED))
def test_rows_are_aggregated_before_every_shuffle(spark, name):
    assert raw_shuffles(_q(spark, name)) == []


def test_sort_merge_lookup_reuses_the_aggregate_partitioning(spark):
    # As at 100 TB: the dimension is too large to broadcast.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = node_names(_q(spark, "funnel_by_source"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = nodes.index("SortMergeJoin")
    # events side: Sort directly over the per-user aggregate, no exchange in between
    assert nodes[join + 1] == "Sort" and nodes[join + 2] == "HashAggregate"
