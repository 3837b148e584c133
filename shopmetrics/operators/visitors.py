"""Distinct users per period that can be rolled up and merged without the events.

Distinct counts of hours do not add up to those of a month. Stored instead are sets:
every user gets a dense number once, and a period's users are bitmaps over the
numbers, 32,768 to a bitmap (``bitmap_construct_agg``). The sets of hours unite to
those of days or months, and sets of new events unite with stored ones
(``bitmap_or_agg``); a count is the number of bits set. All of it is exact.

Scale: events are reduced to distinct (period, user) pairs where they are read,
so a user with a third of all events leaves each task as one row per period. A
bitmap is 4 KB whatever it holds; a period's set is as many of them as its users'
numbers touch, each a group of its own, so no period has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopmetrics.functions.time import GRAINS, period_start

PARTS = 256  # parts in which new users are numbered side by side


def number_users(users: DataFrame, user: str = "user_id", known: DataFrame | None = None,
                 parts: int = PARTS) -> DataFrame:
    """``(user, number)``: dense numbers from 1 for the distinct users, NULL left out.

    With ``known`` (numbers given before), its rows stay as they are and only
    users that it lacks get numbers, beginning after its greatest. Users are
    numbered part by part (a hash), each part after those before it: the only
    window without a partition sees ``parts`` rows.
    """
    new = users.select(user).where(F.col(user).isNotNull()).distinct()
    first = F.lit(0).cast("long")
    if known is not None:
        new = new.join(known.select(user), user, "left_anti")
        first = F.coalesce(known.agg(F.max("number")).scalar(), F.lit(0).cast("long"))
    new = new.withColumn("_part", F.pmod(F.xxhash64(user), F.lit(parts)))
    sizes = new.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = (new.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(user)))
                .join(F.broadcast(offsets), "_part")  # at most ``parts`` rows
                .select(user, (F.col("_before") + F.col("_at") + first).alias("number")))
    return numbered if known is None else known.select(user, "number").unionByName(numbered)


def period_sets(events: DataFrame, numbers: DataFrame, grain: str = "hour", user: str = "user_id",
                ts: str = "created_at") -> DataFrame:
    """``(period, bucket, users)``: the users with an event in each period, as bitmaps over their numbers.

    Events without a user are in no set; events without a time make the period NULL.
    """
    pairs = events.where(F.col(user).isNotNull()).select(period_start(events, ts, grain).alias("period"), user).distinct()
    at = pairs.join(numbers, user).select("period", F.bitmap_bucket_number("number").alias("bucket"),
                                          F.bitmap_bit_position("number").alias("_bit"))
    return at.groupBy("period", "bucket").agg(F.bitmap_construct_agg("_bit").alias("users"))


def merge_sets(*sets: DataFrame) -> DataFrame:
    """The union of stored sets and new ones, period by period."""
    out = sets[0].select("period", "bucket", "users")
    for s in sets[1:]:
        out = out.unionByName(s.select("period", "bucket", "users"))
    return out.groupBy("period", "bucket").agg(F.bitmap_or_agg("users").alias("users"))


def roll_up(sets: DataFrame, grain: str) -> DataFrame:
    """The sets of a coarser grain from those of a finer one."""
    coarser = sets.withColumn("period", period_start(sets, "period", grain))
    return coarser.groupBy("period", "bucket").agg(F.bitmap_or_agg("users").alias("users"))


def distinct_users(sets: DataFrame) -> DataFrame:
    """``(period, visitors)``: how many users each period's set holds."""
    return sets.groupBy("period").agg(F.sum(F.bitmap_count("users")).cast("long").alias("visitors"))


def visitors_by_grain(sets: DataFrame, grains: tuple[str, ...] = ("hour", "day", "month")) -> DataFrame:
    """``(grain, period, visitors)`` for every grain, from the sets of the first; each grain from the one before it."""
    unknown = [g for g in grains if g not in GRAINS]
    if unknown:
        raise ValueError(f"grains must be of {GRAINS}, got {unknown}")
    out, at = None, sets
    for k, grain in enumerate(grains):
        at = at if k == 0 else roll_up(at, grain)
        rows = distinct_users(at).select(F.lit(grain).alias("grain"), "period", "visitors")
        out = rows if out is None else out.unionByName(rows)
    return out
