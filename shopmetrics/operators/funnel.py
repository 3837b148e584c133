"""O01-O05 — purchase funnels.

The funnel is open and unordered: a unit (user, session, ...) counts at a
stage when it has any event of that stage; neither time order nor earlier
stages are required.

Plan shape (two-phase distinct count). ``COUNT(DISTINCT CASE ...)`` per
stage would make Spark ``Expand`` every row once per stage. Instead:

1. ``groupBy(dims..., unit).agg(max(flag_i)...)`` — one row per unit with an
   existence flag per stage. Partial aggregation runs map-side, so a unit
   with a third of all events leaves each map task as a single row.
2. ``groupBy(dims...).agg(sum(flag_i)...)`` — a tiny shuffle of one row per
   (dims, unit).

``flag_i`` is 1 only when the unit is not null, which makes the sum equal to
``COUNT(DISTINCT CASE WHEN event = s_i THEN unit END)``; rows with a null
unit are kept in the per-dimension forms so that a dimension value whose
units are all null still appears, with zero counts.

When the dimension lives on another table (e.g. traffic source on users),
pass it as ``lookup``: events are pre-aggregated to one row per
(key, unit) — and, when each unit has a single key, further to one row per
key with per-stage unit counts — before the join, so the join sees
aggregated rows instead of raw events and a hot key cannot skew it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.sql import ident, lit, one_row_per_key, pct_sql

# The reference's stage order and its chart labels.
DEFAULT_STAGES = ("home", "category", "product", "cart", "purchase")
DEFAULT_LABELS = ("Home", "Category", "Product\nView", "Add to\nCart", "Purchase")


def _dims(dim: str | Sequence[str] | None) -> list[str]:
    if dim is None:
        return []
    return [dim] if isinstance(dim, str) else list(dim)


def _known(unit: str | Sequence[str]) -> str:
    """SQL: no column of the unit is NULL."""
    return " AND ".join(f"{ident(u)} IS NOT NULL" for u in _dims(unit))


def _flag_max(event_col: str, unit: str | Sequence[str], stage: str, name: str) -> Column:
    flag = f"CASE WHEN {ident(event_col)} = {lit(stage)} AND {_known(unit)} THEN 1 ELSE 0 END"
    return F.expr(f"max({flag})").alias(name)


def _sums(k: int, default_zero: bool = False) -> list[Column]:
    if default_zero:  # sum over no rows is NULL where COUNT(DISTINCT) gives 0
        return [F.expr(f"CAST(coalesce(sum(f{i}), 0) AS BIGINT)").alias(f"n{i}") for i in range(k)]
    return [F.expr(f"CAST(sum(f{i}) AS BIGINT)").alias(f"n{i}") for i in range(k)]


def stage_counts(events: DataFrame, dims: Sequence[str], unit: str | Sequence[str], stages: Sequence[str],
                 event_col: str = "event_type", lookup: DataFrame | None = None,
                 lookup_key: str | None = None, unit_determines_key: bool = False) -> DataFrame:
    """Distinct units per stage, per ``dims``: columns ``dims..., n0, n1, ...`` (bigint).

    ``lookup`` (optional) supplies ``dims`` keyed by ``lookup_key``, a column
    of ``events``; of rows repeating a key the least is used. A unit may span
    several columns. ``unit_determines_key`` says each unit has a single key
    (the unit is the key, or a session of it), which saves a regrouping step
    after the join.
    """
    dims = list(dims)
    flags = [_flag_max(event_col, unit, s, f"f{i}") for i, s in enumerate(stages)]
    if lookup is None:
        per_unit = events.groupBy(*dims, *_dims(unit)).agg(*flags)
    else:
        if lookup_key is None:
            raise ValueError("lookup_key is required with lookup")
        keys = list(dict.fromkeys([lookup_key, *_dims(unit)]))
        pre = events.groupBy(*keys).agg(*flags)
        dim = one_row_per_key(lookup, lookup_key, dims)
        if unit_determines_key:
            # Each unit has one key, so its flags can be summed per key before the
            # join: the join sees one row per key, and in a sort-merge join this
            # side is already partitioned by the key.
            if len(keys) > 1:
                pre = pre.groupBy(lookup_key).agg(
                    *[F.expr(f"CAST(sum(f{i}) AS BIGINT)").alias(f"f{i}") for i in range(len(stages))])
            per_unit = pre.join(dim, on=lookup_key, how="left")
        else:
            per_unit = (pre.join(dim, on=lookup_key, how="left")
                        .groupBy(*dims, *_dims(unit)).agg(*[F.max(f"f{i}").alias(f"f{i}") for i in range(len(stages))]))
    return per_unit.groupBy(*dims).agg(*_sums(len(stages)))


def _overall_counts(events: DataFrame, unit: str | Sequence[str], stages: Sequence[str], event_col: str) -> DataFrame:
    # Without a dimension, events outside the stages can be dropped at the scan.
    stage_list = ", ".join(lit(s) for s in stages)
    ev = events.where(f"{ident(event_col)} IN ({stage_list}) AND {_known(unit)}")
    per_unit = ev.groupBy(*_dims(unit)).agg(*[_flag_max(event_col, unit, s, f"f{i}") for i, s in enumerate(stages)])
    return per_unit.agg(*_sums(len(stages), default_zero=True))


def _step_rates(stages: Sequence[str]) -> list[str]:
    return [f"{pct_sql(f'n{i + 1}', f'n{i}', 1)} AS {ident(f'pct_{stages[i]}_to_{stages[i + 1]}')}"
            for i in range(len(stages) - 1)]


def _sorted_by_rate(df: DataFrame, rate: str, dims: list[str]) -> DataFrame:
    return df.orderBy(F.col(rate).desc_nulls_last(), *[F.col(d).asc_nulls_last() for d in dims])


def funnel_overall(events: DataFrame, unit: str | Sequence[str] = "user_id", stages: Sequence[str] = DEFAULT_STAGES,
                   event_col: str = "event_type") -> DataFrame:
    """O01 — one row: ``stage_{i}_{s}`` units per stage, step rates (1 digit),
    ``overall_conversion_rate_pct`` (2 digits), last stage over first."""
    stages = list(stages)
    last = len(stages) - 1
    return _overall_counts(events, unit, stages, event_col).selectExpr(
        *[f"n{i} AS {ident(f'stage_{i + 1}_{s}')}" for i, s in enumerate(stages)],
        *_step_rates(stages),
        f"{pct_sql(f'n{last}', 'n0', 2)} AS overall_conversion_rate_pct",
    )


def funnel_long(events: DataFrame, unit: str | Sequence[str] = "user_id", stages: Sequence[str] = DEFAULT_STAGES,
                labels: Sequence[str] | None = None, event_col: str = "event_type") -> DataFrame:
    """O02 — one row per stage: ``stage_no, stage, users, conversion_from_top_pct,
    drop_off_pct``; drop-off is ``(1 - users / previous) * 100`` and NULL at the top.

    Computed on the one-row counts and then turned into rows with ``inline``:
    no window and no sort over data are needed.
    """
    return long_rows(_overall_counts(events, unit, list(stages), event_col), stages, labels)


def long_rows(counts: DataFrame, stages: Sequence[str] = DEFAULT_STAGES,
              labels: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The rows of O02 from one row of counts ``n0, n1, ...``, with the columns in ``keep`` beside them."""
    stages = list(stages)
    labels = list(labels) if labels is not None else stages
    if len(labels) != len(stages):
        raise ValueError("labels and stages differ in length")
    rows = []
    for i, label in enumerate(labels):
        drop = ("CAST(NULL AS DOUBLE)" if i == 0
                else f"round((1.0D - CAST(n{i} AS DOUBLE) / nullif(CAST(n{i - 1} AS DOUBLE), 0.0D)) * 100.0D, 1)")
        rows.append(f"named_struct('stage_no', {i + 1}, 'stage', {lit(label)}, 'users', n{i}, "
                    f"'conversion_from_top_pct', {pct_sql(f'n{i}', 'n0', 1)}, 'drop_off_pct', {drop})")
    return counts.selectExpr(f"inline(array({', '.join(rows)}))", *[ident(c) for c in keep])


def stage_totals(stages: Sequence[str]) -> list[Column]:
    """Overall counts ``n0, n1, ...`` from :func:`stage_counts` by a property each unit has once."""
    return [F.expr(f"CAST(coalesce(sum(n{i}), 0) AS BIGINT)").alias(f"n{i}") for i in range(len(stages))]


def funnel_by(events: DataFrame, dim: str | Sequence[str] = "traffic_source", unit: str | Sequence[str] = "user_id",
              stages: Sequence[str] = DEFAULT_STAGES, event_col: str = "event_type",
              lookup: DataFrame | None = None, lookup_key: str | None = None,
              unit_determines_key: bool = False) -> DataFrame:
    """O03 — per dimension value: ``users_{s}`` per stage, step rates (1 digit),
    ``overall_conversion_pct`` (2); sorted by overall conversion, descending,
    NULLs last, then by the dimension."""
    stages = list(stages)
    dims = _dims(dim)
    last = len(stages) - 1
    counts = stage_counts(events, dims, unit, stages, event_col, lookup, lookup_key, unit_determines_key)
    out = counts.selectExpr(
        *[ident(d) for d in dims],
        *[f"n{i} AS {ident(f'users_{s}')}" for i, s in enumerate(stages)],
        *_step_rates(stages),
        f"{pct_sql(f'n{last}', 'n0', 2)} AS overall_conversion_pct",
    )
    return _sorted_by_rate(out, "overall_conversion_pct", dims)


def funnel_by_compact(events: DataFrame, dim: str | Sequence[str] = "traffic_source", unit: str | Sequence[str] = "user_id",
                      stages: Sequence[str] = DEFAULT_STAGES, event_col: str = "event_type",
                      lookup: DataFrame | None = None, lookup_key: str | None = None,
                      unit_determines_key: bool = False) -> DataFrame:
    """O04 — per dimension value: one count column per stage (named by the stage),
    ``conversion_pct`` (last over first, 2 digits) and
    ``{penultimate}_to_{last}_pct`` (1 digit); sorted by conversion, descending."""
    dims = _dims(dim)
    counts = stage_counts(events, dims, unit, list(stages), event_col, lookup, lookup_key, unit_determines_key)
    return compact_rows(counts, dims, stages)


def compact_rows(counts: DataFrame, dim: str | Sequence[str], stages: Sequence[str] = DEFAULT_STAGES) -> DataFrame:
    """The rows of O04 from :func:`stage_counts`."""
    dims, stages = _dims(dim), list(stages)
    last = len(stages) - 1
    out = counts.selectExpr(
        *[ident(d) for d in dims],
        *[f"n{i} AS {ident(s)}" for i, s in enumerate(stages)],
        f"{pct_sql(f'n{last}', 'n0', 2)} AS conversion_pct",
        f"{pct_sql(f'n{last}', f'n{last - 1}', 1)} AS {ident(f'{stages[-2]}_to_{stages[-1]}_pct')}",
    )
    return _sorted_by_rate(out, "conversion_pct", dims)


def funnel_by_device(events: DataFrame, dim: str | Sequence[str] = "device_type", unit: str | Sequence[str] = "user_id",
                     stages: Sequence[str] = DEFAULT_STAGES, event_col: str = "event_type") -> DataFrame:
    """O05 — per device: first- and last-stage units, then the last three steps:
    ``pct_reached_{s[-3]}`` (over the *first* stage, skipping those between),
    ``pct_{s[-3]}_to_{s[-2]}``, ``pct_{s[-2]}_to_{s[-1]}`` (1 digit) and
    ``overall_conversion_pct`` (2). A device is an event property, so one unit
    may count under several devices."""
    stages = list(stages)
    if len(stages) < 3:
        raise ValueError("funnel_by_device needs at least three stages")
    dims = _dims(dim)
    a, b, c = len(stages) - 3, len(stages) - 2, len(stages) - 1
    counts = stage_counts(events, dims, unit, stages, event_col)
    out = counts.selectExpr(
        *[ident(d) for d in dims],
        f"n0 AS {ident(f'users_{stages[0]}')}",
        f"n{c} AS {ident(f'users_{stages[-1]}')}",
        f"{pct_sql(f'n{a}', 'n0', 1)} AS {ident(f'pct_reached_{stages[a]}')}",
        f"{pct_sql(f'n{b}', f'n{a}', 1)} AS {ident(f'pct_{stages[a]}_to_{stages[b]}')}",
        f"{pct_sql(f'n{c}', f'n{b}', 1)} AS {ident(f'pct_{stages[b]}_to_{stages[c]}')}",
        f"{pct_sql(f'n{c}', 'n0', 2)} AS overall_conversion_pct",
    )
    return _sorted_by_rate(out, "overall_conversion_pct", dims)


def funnel_dimensions(events: DataFrame, dims: Sequence[str], unit: str | Sequence[str] = "user_id",
                      stages: Sequence[str] = DEFAULT_STAGES, event_col: str = "event_type", overall: bool = True,
                      lookup: DataFrame | None = None, lookup_key: str | None = None) -> DataFrame:
    """The funnels of O01 and of O03 by each of ``dims``, from one pass over the events.

    ``dimension, value, users_{s}..., step rates, overall_conversion_pct`` as in
    O03; ``dimension`` is ``overall`` (value NULL) or a column's name, and values
    are text. Events are reduced to one row per unit and combination of
    dimensions first; grouping sets then copy only those rows, once per funnel.
    ``lookup`` supplies those of ``dims`` that events lack, keyed by ``lookup_key``.
    """
    dims, units, stages = list(dims), _dims(unit), list(stages)
    if not dims or "overall" in dims:
        raise ValueError("funnel_dimensions needs dimensions, none of them named 'overall'")
    via = [] if lookup is None else [d for d in dims if d not in events.columns]
    if via and lookup_key is None:
        raise ValueError("lookup_key is required with lookup")
    own = [d for d in dims if d not in via]
    flags = [_flag_max(event_col, unit, s, f"f{i}") for i, s in enumerate(stages)]
    names = {**{u: f"_u{i}" for i, u in enumerate(units)}, **({lookup_key: "_k"} if via and lookup_key not in units else {})}
    per_unit = events.groupBy(*[F.col(c).alias(n) for c, n in names.items()],
                              *[F.col(d).cast("string").alias(f"_d{dims.index(d)}") for d in own]).agg(*flags)
    if via:
        key = names[lookup_key]
        dim = one_row_per_key(lookup, lookup_key, via).select(
            F.col(lookup_key).alias(key), *[F.col(d).cast("string").alias(f"_d{dims.index(d)}") for d in via])
        per_unit = per_unit.join(dim, key, "left")
    us, ds = [names[u] for u in units], [f"_d{i}" for i in range(len(dims))]
    sets = ([us] if overall else []) + [[*us, d] for d in ds]
    of_unit = per_unit.groupingSets([[F.col(c) for c in x] for x in sets], *us, *ds).agg(
        *[F.max(f"f{i}").alias(f"f{i}") for i in range(len(stages))], *[F.grouping(d).alias(f"_out{d}") for d in ds])
    which = " ".join(f"WHEN _out{d} = 0 THEN {lit(name)}" for d, name in zip(ds, dims))
    counts = (of_unit.selectExpr(f"CASE {which} ELSE 'overall' END AS dimension", f"coalesce({', '.join(ds)}) AS value",
                                 *[f"f{i}" for i in range(len(stages))])
              .groupBy("dimension", "value").agg(*_sums(len(stages))))
    last = len(stages) - 1
    return counts.selectExpr("dimension", "value", *[f"n{i} AS {ident(f'users_{s}')}" for i, s in enumerate(stages)],
                             *_step_rates(stages), f"{pct_sql(f'n{last}', 'n0', 2)} AS overall_conversion_pct")
