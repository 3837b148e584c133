"""Column helpers: ratios, money, periods, month offsets."""

import datetime as dt

from pyspark.sql import functions as F

from shopmetrics.functions.ratios import exact_mean, pct, safe_div, total
from shopmetrics.functions.sql import ident, lit
from shopmetrics.functions.time import month_offset, period_start, period_text


def test_pct_and_div(spark):
    df = spark.createDataFrame([(1, 16), (1, 400), (3, 0), (None, 5)], "a BIGINT, b BIGINT")
    got = df.select(pct("a", "b", 1).alias("p"), pct(F.col("a"), F.col("b"), 1).alias("q"),
                    safe_div("a", "b").alias("d")).collect()
    assert [r["p"] for r in got] == [6.3, 0.3, None, None]          # half-up ties, NULL on zero
    assert [r["q"] for r in got] == [r["p"] for r in got]            # Column and SQL forms agree
    assert got[2]["d"] is None


def test_total_and_mean_are_unrounded_and_exact(spark):
    def of(*values):
        df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
        return tuple(df.agg(total("x").alias("s"), exact_mean("x").alias("m")).first())

    s, m = of(0.1, 0.2, 0.7, None)
    assert s == 1.0 and abs(m - 1.0 / 3) < 1e-15
    assert of(0.004, 0.004) == (0.008, 0.004)
    assert of(1e-7, 1e-7) == (2e-7, 1e-7)                     # below the exact range: summed as doubles
    assert of(2e16, 1.0)[0] == 2e16 + 1.0 and of(1e300)[0] == 1e300
    assert of(float("nan"), 3.0) == (3.0, 3.0)                 # NaN is a missing value
    assert of(None, float("nan")) == (None, None) and of() == (None, None)


def test_period_start_ntz_and_ltz(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 23, 59, 59),)], "t TIMESTAMP_NTZ")
    df = df.withColumn("z", F.col("t").cast("timestamp"))
    r = df.select(*[period_start(df, "t", g).alias(g) for g in ("month", "day", "hour", "year")],
                  period_start(df, "z", "month").alias("zm")).first()
    assert r["month"] == dt.datetime(2024, 3, 1) and r["day"] == dt.datetime(2024, 3, 31)
    assert r["hour"] == dt.datetime(2024, 3, 31, 23) and r["year"] == dt.datetime(2024, 1, 1)
    assert r["zm"] == dt.datetime(2024, 3, 1)                         # session zone is UTC in tests
    assert df.select(period_text(period_start(df, "t", "month"), "month")).first()[0] == "2024-03"


def test_month_offset_is_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 31), dt.datetime(2023, 3, 15)),
                                (dt.datetime(2023, 12, 31), dt.datetime(2024, 1, 1))], "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    assert [r[0] for r in df.select(month_offset("b", "a")).collect()] == [2, 1]


def test_sql_quoting():
    assert ident("a`b") == "`a``b`"
    assert lit("it's\nok") == "'it\\'s\\nok'"


def test_scale_conf_sizes_partitions():
    from shopmetrics.session import scale_conf

    c = scale_conf(100 * 1024**4, total_cores=8000)          # 100 TiB on 1,000 executors x 8 cores
    assert int(c["spark.sql.shuffle.partitions"]) == 409600   # 256 MiB of input per partition
    assert c["spark.sql.adaptive.enabled"] == "true"
    small = scale_conf(10 * 1024**2, total_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16   # at least two waves of tasks


def test_period_text_does_not_pass_through_the_session_zone(spark):
    hours = [dt.datetime(2024, 3, 10, h) for h in (1, 2, 3)] + [None]  # 02:00 does not exist in Los Angeles
    df = spark.createDataFrame([(h,) for h in hours], "t TIMESTAMP_NTZ")
    grains = ("year", "quarter", "month", "week", "day", "hour")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = set()
        for zone in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seen.add(tuple(df.select(*[period_text(period_start(df, "t", g), g) for g in grains]).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    rows = seen.pop()
    assert not seen
    assert [tuple(r) for r in rows] == [("2024", "2024-01", "2024-03", "2024-03-04", "2024-03-10", f"2024-03-10 0{h}:00")
                                        for h in (1, 2, 3)] + [(None,) * 6]
