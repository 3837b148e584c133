"""Exact quantiles per group, by histograms over ranges that shrink pass by pass.

A quantile of ``n`` values is interpolated between the values of two ranks. Every
rank starts with the range of its group's values. A pass counts the values of a range
in ``BUCKETS`` buckets and keeps each bucket's least and greatest value; the
bucket that holds the rank becomes its range. Buckets are equally wide, or equally
wide in the logarithm where a range spans several powers of ten, or parted at zero
and at infinities, so any doubles need few passes. Once a range holds one value,
or at most ``FINISH`` rows, the rank is read off it.

Neither the table nor a group is ever sorted or gathered. Counts are combined where
rows are read, so a group with a third of all rows costs a row per bucket and task; the
ranges are one row per group and rank, and Spark joins them to the rows as their
size suggests. Windows see at most ``BUCKETS`` counts, or ``FINISH`` rows of a range.
The values (groups and one column) are written once and read by every pass; so is
the state between passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopmetrics.functions.ratios import present_sql
from shopmetrics.functions.sql import ident
from shopmetrics.sources.scratch import scratch_folder, written

BUCKETS = 4096
FINISH = 10_000
LOG_FROM = 1000  # ratio of a range's ends from which its buckets are logarithmic


def _kind(x: str) -> str:
    return (f"CASE WHEN {x} = DOUBLE('-Infinity') THEN 0 WHEN {x} < 0 THEN 1 WHEN {x} = 0 THEN 2 "
            f"WHEN {x} < DOUBLE('Infinity') THEN 3 ELSE 4 END")


def _bucket(buckets: int) -> str:
    """SQL: the bucket of ``v`` in the range from ``lo`` to ``hi``; it never falls as ``v`` rises."""
    wide = f"greatest(abs(lo), abs(hi)) / least(abs(lo), abs(hi)) > {LOG_FROM}"
    share = f"CASE WHEN {wide} THEN (ln(abs(v)) - ln(abs(lo))) / (ln(abs(hi)) - ln(abs(lo))) ELSE (v - lo) / (hi - lo) END"
    return (f"CASE WHEN lo = hi THEN 0 WHEN {_kind('lo')} <> {_kind('hi')} THEN {_kind('v')} "
            f"ELSE CAST(least({buckets - 1}, floor({buckets} * ({share}))) AS INT) END")


def _name(p: float) -> str:
    return "p" + f"{100 * p:g}".replace(".", "_")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the group columns, so NULL is a group of its own."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float] = (0.5, 0.9, 0.99),
                    by: str | Sequence[str] = (), buckets: int = BUCKETS, finish: int = FINISH) -> DataFrame:
    """Per group: its columns, ``n`` (present values) and ``p50``, ``p90``, ... for ``probs``.

    Quantiles are continuous, as SQL's ``PERCENTILE_CONT``: of ``n`` values the
    one at place ``p (n - 1)``, interpolated between its neighbours. NULL and NaN
    are missing; a group without a value has ``n`` 0 and NULL quantiles. NULL is a
    group of its own. Without ``by`` there is one row.
    """
    by = [by] if isinstance(by, str) else list(by)
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs must lie between 0 and 1")
    keys = [f"g{i}" for i in range(len(by))]
    folder = scratch_folder(df.sparkSession)
    rows = written(df.selectExpr(*[f"{ident(c)} AS {k}" for c, k in zip(by, keys)], f"{present_sql(ident(value))} AS v"),
                   folder, "values")
    groups = written(rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")),
                     folder, "groups")
    places = ", ".join(f"named_struct('i', {i}, 'at', {float(p)!r}D * (n - 1))" for i, p in enumerate(probs))
    ranks = groups.where("n > 0").selectExpr(*keys, "n", "lo", "hi", f"explode(array({places})) AS p").selectExpr(
        *keys, "n", "lo", "hi", "explode(array_distinct(array(CAST(floor(p.at) AS BIGINT), CAST(ceil(p.at) AS BIGINT)))) AS k")
    state = written(ranks.distinct().selectExpr(*keys, "k", "lo", "hi", "k AS within", "n AS size"), folder, "state-0")
    wide = f"lo < hi AND size > {int(finish)}"
    at = 0
    while not state.where(wide).isEmpty():
        at += 1
        state = written(_narrowed(rows, state, keys, wide, buckets), folder, f"state-{at}")
    found = written(state.where("lo = hi").selectExpr(*keys, "k", "lo AS v").unionByName(_read_off(rows, state, keys)),
                    folder, "found")
    return _interpolated(groups, found, keys, by, probs)


def _in_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the one range of their group that holds them; ranges of a group never overlap."""
    a, b = rows.alias("a"), ranges.select(*[F.col(k).alias(f"r{k}") for k in keys], "lo", "hi").alias("b")
    on = F.expr(" AND ".join([f"a.{k} <=> b.r{k}" for k in keys] + ["a.v BETWEEN b.lo AND b.hi"]))
    return a.join(b, on).select(*keys, "v", "lo", "hi")


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], wide: str, buckets: int) -> DataFrame:
    """One pass: every rank of a wide range gets the range of the bucket that holds it."""
    ranges = state.where(wide).select(*keys, "lo", "hi").distinct()
    counts = (_in_ranges(rows, ranges, keys).withColumn("bucket", F.expr(_bucket(buckets)))
              .groupBy(*keys, "lo", "hi", "bucket").agg(F.count("*").alias("size"), F.min("v").alias("from_v"),
                                                        F.max("v").alias("to_v")))
    before = Window.partitionBy(*keys, "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    a, b = state.where(wide).alias("a"), counts.alias("b")
    on = F.expr(" AND ".join([f"a.{k} <=> b.{k}" for k in keys] + [
        "a.lo = b.lo", "a.hi = b.hi", "a.within >= b.before", "a.within < b.before + b.size"]))
    moved = a.join(b, on).selectExpr(*[f"a.{k}" for k in keys], "a.k", "b.from_v AS lo", "b.to_v AS hi",
                                     "a.within - b.before AS within", "b.size AS size")
    return moved.unionByName(state.where(f"NOT ({wide})"))


def _read_off(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values of ranks whose range holds few rows."""
    small = state.where("lo < hi")
    inside = _in_ranges(rows, small.select(*keys, "lo", "hi").distinct(), keys).withColumn(
        "place", F.row_number().over(Window.partitionBy(*keys, "lo", "hi").orderBy("v")) - 1)
    a, b = small.alias("a"), inside.alias("b")
    on = F.expr(" AND ".join([f"a.{k} <=> b.{k}" for k in keys] + ["a.lo = b.lo", "a.hi = b.hi", "a.within = b.place"]))
    return a.join(b, on).selectExpr(*[f"a.{k}" for k in keys], "a.k", "b.v")


def _interpolated(groups: DataFrame, found: DataFrame, keys: list[str], by: list[str], probs: Sequence[float]) -> DataFrame:
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("at"))
    a, b = groups.alias("a"), values.alias("b")
    both = a.join(b, F.expr(" AND ".join([f"a.{k} <=> b.{k}" for k in keys] or ["true"])), "left") if keys else a.join(
        b, F.lit(True), "left")
    out = []
    for p in probs:
        place = f"{float(p)!r}D * (n - 1)"
        low, high = f"at[CAST(floor({place}) AS BIGINT)]", f"at[CAST(ceil({place}) AS BIGINT)]"
        part = f"({place} - floor({place}))"
        out.append(f"CASE WHEN n > 0 THEN CASE WHEN {low} = {high} THEN {low} ELSE {low} * (1.0D - {part}) + {high} * {part} END END "
                   f"AS {_name(p)}")
    return both.selectExpr(*[f"a.{k} AS {ident(c)}" for k, c in zip(keys, by)], "a.n AS n", *out)
