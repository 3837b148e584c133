"""Every registered query against its DuckDB oracle at sf0.01, as the driver does."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    # the training-data queries have tests of their own where SQL cannot express them
    assert set(entry.queries()) - set(entry.LLM_QUERIES) == set(entry.oracle_sql()) - set(entry.LLM_ORACLE_SQL)
    assert set(entry.LLM_ORACLE_SQL) <= set(entry.LLM_QUERIES)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.LLM_QUERIES)))
def test_query_matches_oracle(spark, con, name):
    problems = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name], con)
    assert not problems, "\n".join(problems)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns[0] == "traffic_source"


@pytest.mark.parametrize("name", ["cohort_retention", "revenue_trend_hourly", "revenue_trend_export",
                                  "duplicate_keys", "funnel_overall"])
def test_results_do_not_depend_on_session_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        problems = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name], con)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert not problems, "\n".join(problems)
