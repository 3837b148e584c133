"""Mergeable distinct counts: bitmaps of hours against direct counts, merging, numbering, plans."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shopmetrics.operators import visitors as vs
from shopmetrics.plans.inspect import has_python, raw_shuffles


def _events(spark, n=3000, users=400, seed=5, days=70):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        user = 1 if rng.random() < 0.33 else rng.randrange(users) * 10 ** 12  # a hot user, sparse ids
        rows.append((None if rng.random() < 0.02 else user,
                     None if rng.random() < 0.02 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(days * 1440))))
    return spark.createDataFrame(rows, "user_id BIGINT, created_at TIMESTAMP_NTZ")


def _direct(df, grain):
    out = {}
    for r in df.collect():
        t = r["created_at"]
        if t is not None:
            t = t.replace(minute=0) if grain == "hour" else t.replace(hour=0, minute=0)
            t = t.replace(day=1) if grain == "month" else t
        if r["user_id"] is not None:
            out.setdefault(t, set()).add(r["user_id"])
    return {k: len(v) for k, v in out.items()}


def _got(df):
    return {r["period"]: r["visitors"] for r in df.collect()}


def test_numbers_are_dense_and_stay(spark):
    ev = _events(spark)
    one = vs.number_users(ev, parts=7)
    numbers = sorted(r["number"] for r in one.collect())
    assert numbers == list(range(1, len(numbers) + 1))
    more = ev.select("user_id").unionByName(spark.range(10_000, 10_050).select(F.col("id").alias("user_id")))
    two = {r["user_id"]: r["number"] for r in vs.number_users(more, known=one, parts=7).collect()}
    assert {r["user_id"]: r["number"] for r in one.collect()}.items() <= two.items()
    assert sorted(two.values()) == list(range(1, len(numbers) + 51))
    assert vs.number_users(ev.limit(0)).count() == 0
    assert vs.number_users(ev, known=one.limit(0)).count() == len(numbers)


def test_hours_roll_up_to_days_and_months(spark, tmp_path):
    ev = _events(spark)
    vs.period_sets(ev, vs.number_users(ev), "hour").write.parquet(f"{tmp_path}/hours")
    hours = spark.read.parquet(f"{tmp_path}/hours")
    rows = vs.visitors_by_grain(hours, ("hour", "day", "month"))
    for grain in ("hour", "day", "month"):
        assert _got(rows.where(F.col("grain") == grain)) == _direct(ev, grain)
    files = vs.distinct_users(vs.roll_up(hours, "month")).inputFiles()
    assert files and all("/hours/" in f for f in files)  # the events are not read


def test_many_bitmaps_per_period(spark):
    ev = spark.range(100_000).select(F.col("id").alias("user_id"), F.lit(dt.datetime(2024, 5, 5)).cast("timestamp_ntz").alias("created_at"))
    sets = vs.period_sets(ev, vs.number_users(ev), "day")
    assert sets.count() == 4  # 32,768 numbers to a bitmap
    assert _got(vs.distinct_users(sets)) == {dt.datetime(2024, 5, 5): 100_000}


def test_new_events_merge_into_stored_sets(spark):
    old, new = _events(spark, seed=1), _events(spark, n=900, users=900, seed=2, days=90)
    numbers = vs.number_users(old)
    stored = vs.period_sets(old, numbers, "day")
    more = vs.number_users(new, known=numbers)
    merged = vs.merge_sets(stored, vs.period_sets(new, more, "day"))
    both = old.unionByName(new)
    assert _got(vs.distinct_users(merged)) == _direct(both, "day")
    assert _got(vs.distinct_users(vs.roll_up(merged, "month"))) == _direct(both, "month")
    assert vs.merge_sets(stored, stored.limit(0)).count() == stored.count()


def test_pairs_are_reduced_before_they_are_shuffled(spark):
    ev = _events(spark)
    sets = vs.period_sets(ev, vs.number_users(ev))
    assert not has_python(sets) and not raw_shuffles(sets)
