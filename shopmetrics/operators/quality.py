"""O09-O16, O22-O24 — data-quality checks and input profiles.

Each check is one pass of aggregation over its table. Aggregates are
partial map-side, so no key (however hot) reaches a single task as raw
rows. Global values a check needs (mean, deviation, totals) are scalar
subqueries: computed once and used as constants, never joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.exact import mean_and_deviation
from shopmetrics.functions.ratios import exact_mean, pct
from shopmetrics.functions.sql import ident, lit, one_row_per_key, pct_sql


def _null_sum(c: str) -> Column:
    # SUM(CASE WHEN c IS NULL THEN 1 ELSE 0 END): NULL on an empty table.
    return F.expr(f"CAST(sum(CASE WHEN {ident(c)} IS NULL THEN 1 ELSE 0 END) AS BIGINT)")


# --------------------------------------------------------------------------- O09
def null_audit_union(events: DataFrame, orders: DataFrame,
                     events_cols: Sequence[str] = ("user_id", "session_id", "event_type",
                                                   "created_at", "traffic_source"),
                     orders_cols: Sequence[str] = ("user_id", "total_sale_price", "status",
                                                   "created_at"),
                     lookup: DataFrame | None = None, lookup_key: str | None = None) -> DataFrame:
    """O09 — two rows, ``table_name, total_rows, null_user_id, null_session_id,
    null_event_type, null_created_at, null_traffic_source``.

    The union is positional and the names come from the events branch, as in
    the reference: the orders row reports null prices under
    ``null_session_id``, null statuses under ``null_event_type`` and a
    constant 0 under ``null_traffic_source``. ``null_audit`` is the clean form.

    ``lookup`` (optional) supplies audited event columns that live on a
    dimension keyed by ``lookup_key`` (e.g. a user's traffic source), as a
    left join would: events are first reduced to one row per key with their
    row and null counts, and only those rows meet the dimension.
    """
    names = ["null_" + c for c in events_cols]
    if lookup is None:
        ev = events.agg(F.count(F.lit(1)).alias("total_rows"),
                        *[_null_sum(c).alias(n) for c, n in zip(events_cols, names)])
    else:
        if lookup_key is None:
            raise ValueError("lookup_key is required with lookup")
        via = [c for c in events_cols if c not in events.columns]
        per_key = events.groupBy(F.col(lookup_key).alias("_k")).agg(
            F.count(F.lit(1)).alias("_n"),
            *[_null_sum(c).alias(f"_d{i}") for i, c in enumerate(events_cols) if c not in via])
        dim = one_row_per_key(lookup, lookup_key, via).withColumnRenamed(lookup_key, "_k")
        joined = per_key.join(dim, on="_k", how="left")
        sums = [F.expr(f"CAST(sum(CASE WHEN {ident(c)} IS NULL THEN _n ELSE 0 END) AS BIGINT)") if c in via
                else F.expr(f"CAST(sum(_d{i}) AS BIGINT)") for i, c in enumerate(events_cols)]
        ev = joined.agg(F.expr("CAST(coalesce(sum(_n), 0) AS BIGINT)").alias("total_rows"),
                        *[x.alias(n) for x, n in zip(sums, names)])
    ev = ev.select(F.lit("events").alias("table_name"), "*")
    od = orders.agg(F.count(F.lit(1)).alias("total_rows"),
                    *[_null_sum(c).alias(f"c{i}") for i, c in enumerate(orders_cols)])
    pad = [F.lit(0).cast("long").alias(f"p{i}") for i in range(len(events_cols) - len(orders_cols))]
    od = od.select(F.lit("orders").alias("table_name"), "*", *pad)
    return ev.union(od)


# --------------------------------------------------------------------------- O10
def null_audit(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """O10 — per column with at least one NULL: ``table_name, column_name,
    null_count, null_pct`` (2 digits of the table's rows).

    One aggregate over all columns (a single scan), then ``stack`` into rows.
    """
    cols = list(columns) if columns is not None else df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.expr(f"count_if({ident(c)} IS NULL)").alias(f"_n{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"{lit(c)}, _n{i}" for i, c in enumerate(cols))
    long = counts.select("_rows", F.expr(f"stack({len(cols)}, {pairs}) AS (column_name, null_count)"))
    return long.where("null_count > 0").selectExpr(
        f"{lit(name)} AS table_name", "column_name", "null_count",
        f"{pct_sql('null_count', '_rows', 2)} AS null_pct")


def null_audit_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """O10 over several tables at once (the reference audits events, users, orders)."""
    frames = [null_audit(df, name) for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def null_and_row_counts(tables: dict[str, DataFrame], audited: Sequence[str]) -> DataFrame:
    """``table_name, column_name, n``: one aggregate per table gives its rows (NULL
    column name) and, for the ``audited`` tables, the NULLs of every column."""
    out = None
    for name, df in tables.items():
        cols = df.columns if name in audited else []
        counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                        *[F.expr(f"count_if({ident(c)} IS NULL)").alias(f"_n{i}") for i, c in enumerate(cols)])
        pairs = ", ".join(["CAST(NULL AS STRING), _rows"] + [f"{lit(c)}, _n{i}" for i, c in enumerate(cols)])
        long = counts.selectExpr(f"{lit(name)} AS table_name", f"stack({len(cols) + 1}, {pairs}) AS (column_name, n)")
        out = long if out is None else out.unionByName(long)
    return out


def nulls_of(counts: DataFrame) -> DataFrame:
    """O10 from :func:`null_and_row_counts`."""
    rows = counts.where("column_name IS NULL").selectExpr("table_name", "n AS _rows")
    return (counts.where("column_name IS NOT NULL AND n > 0").join(rows, "table_name")
            .selectExpr("table_name", "column_name", "n AS null_count", f"{pct_sql('n', '_rows', 2)} AS null_pct"))


def row_counts_of(counts: DataFrame) -> DataFrame:
    """O22 from :func:`null_and_row_counts`."""
    return counts.where("column_name IS NULL").selectExpr("table_name", "n AS row_count")


# --------------------------------------------------------------------------- O11, O12
def _duplicates(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    # NULL keys form their own group, as in SQL's GROUP BY.
    return (events.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
            .where(F.col("occurrences") > 1))


def duplicate_keys(events: DataFrame, keys: Sequence[str] = ("session_id", "event_type"),
                   limit: int | None = 20) -> DataFrame:
    """O11 — key tuples seen more than once with ``occurrences``, most first,
    top ``limit`` (None: all of them). Keys break ties so the cut is
    deterministic; with a limit the plan is a per-partition top-k
    (TakeOrderedAndProject), not a full sort."""
    keys = list(keys)
    found = _duplicates(events, keys).orderBy(F.col("occurrences").desc(),
                                              *[F.col(k).asc_nulls_first() for k in keys])
    return found if limit is None else found.limit(limit)


def duplicate_key_count(events: DataFrame, keys: Sequence[str] = ("session_id", "event_type")) -> DataFrame:
    """O12 — one row, ``duplicate_pairs``: how many key tuples occur more than once."""
    return _duplicates(events, list(keys)).agg(F.count(F.lit(1)).alias("duplicate_pairs"))


# --------------------------------------------------------------------------- O13
def orphan_count(child: DataFrame, parent: DataFrame, fk: str = "user_id", pk: str = "user_id",
                 name: str = "orphaned_event_rows") -> DataFrame:
    """O13 — one row: child rows whose ``fk`` has no parent row (a NULL ``fk`` is an orphan).

    The child is first reduced to one row per key with its count, so the
    anti join sees distinct keys, not raw rows; Spark then picks broadcast
    or sort-merge for it from the sizes it measures.
    """
    per_key = child.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
    parents = parent.select(F.col(pk).alias("_pk"))
    missing = per_key.join(parents, per_key["_fk"] == parents["_pk"], "left_anti")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias(name))


# --------------------------------------------------------------------------- O14
def stage_integrity(events: DataFrame, session: str | Sequence[str] = "session_id", requires: str = "cart",
                    stage: str = "purchase", event_col: str = "event_type",
                    name: str | None = None) -> DataFrame:
    """O14 — one row: sessions with a ``stage`` event but no ``requires`` event."""
    name = name or f"sessions_with_{stage}_no_{requires}"
    per = (events.where(F.col(event_col).isin(requires, stage))
           .groupBy(*([session] if isinstance(session, str) else session))
           .agg(F.max(F.when(F.col(event_col) == requires, 1).otherwise(0)).alias("_had_req"),
                F.max(F.when(F.col(event_col) == stage, 1).otherwise(0)).alias("_had_stage")))
    return per.agg(F.count_if((F.col("_had_stage") == 1) & (F.col("_had_req") == 0)).alias(name))


# --------------------------------------------------------------------------- O15, O16
def _zscore(value: str, mean: Column, std: Column) -> Column:
    # nanvl: a NaN is greater than any number in Spark, and a missing value has no score
    return F.nanvl((F.col(value) - mean) / F.nullif(std, F.lit(0.0)), F.lit(None).cast("double"))


def zscore_outliers(df: DataFrame, value: str = "total_sale_price", key: str = "order_id",
                    k: float = 3.0) -> DataFrame:
    """O15 — rows with ``abs(z) > k`` (strict, unrounded z, sample deviation, both
    tails): ``key, value, z_score`` (2 digits), highest z first.

    A NULL or NaN value is missing: it is in neither mean nor deviation and no
    outlier. A zero deviation makes z NULL and drops every row. Mean and
    deviation are the same in whatever partitions rows come
    (``functions.exact``), and so is the strict test on them. The outliers (by
    Chebyshev at most 1/k^2 of the rows) are dealt out before they are sorted:
    a global sort samples its input, and so samples them, not the table again.
    """
    mean, std = mean_and_deviation(df, ident(value))
    return (df.withColumn("_z", _zscore(value, mean, std)).where(F.abs(F.col("_z")) > k)
            .select(key, value, F.round("_z", 2).alias("z_score"))
            .repartition(key)
            .orderBy(F.col("z_score").desc(), F.col(key).asc()))


def outlier_summary(df: DataFrame, value: str = "total_sale_price", k: float = 3.0) -> DataFrame:
    """O16 — one row: ``total_rows, outliers, outlier_pct`` (1 digit),
    ``mean_value, std_value`` (2 digits); missing values as in O15, though
    ``total_rows`` counts every row."""
    mean, std = mean_and_deviation(df, ident(value))
    z = _zscore(value, mean, std)
    return (df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.abs(z) > k).alias("outliers"))
            .select("total_rows", "outliers", pct("outliers", "total_rows", 1).alias("outlier_pct"),
                    F.round(mean, 2).alias("mean_value"), F.round(std, 2).alias("std_value")))


# --------------------------------------------------------------------------- O22-O24
def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """O22 — ``table_name, row_count`` per input table (one count job per table,
    answered from Parquet metadata where the format allows)."""
    frames = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
              for n, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def value_distribution(df: DataFrame, col: str, normalize: bool = False, weight: str | None = None) -> DataFrame:
    """O23 — per value of ``col``: ``count`` and, with ``normalize``, ``share``
    of all rows (3 digits); most frequent first. NULL is a value of its own.
    ``weight`` names a column with the number of rows a row stands for.

    The share's denominator is the global sum of the per-value counts, a
    scalar subquery (one value, no join); a column with many distinct values
    is never gathered into a single task, as an unpartitioned window would.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight).cast("long")
    counts = df.groupBy(col).agg(rows.alias("count"))
    if normalize:
        total = counts.agg(F.sum("count")).scalar()
        counts = counts.withColumn("share", F.round(F.col("count").cast("double") / total, 3))
    return counts.orderBy(F.col("count").desc(), F.col(col).asc_nulls_last())


def population_profile(events: DataFrame, orders: DataFrame, user: str = "user_id",
                       event_col: str = "event_type", purchase: str = "purchase",
                       value: str = "total_sale_price") -> DataFrame:
    """O24 — one row: ``users`` (distinct users with events), ``buyers`` (distinct
    users with a purchase event), ``avg_order_value`` (over all orders, 2 digits).

    Two-phase distinct count (one row per user, then sums), no Expand.
    """
    per_user = (events.where(F.col(user).isNotNull()).groupBy(user)
                .agg(F.max(F.when(F.col(event_col) == purchase, 1).otherwise(0)).alias("_buyer")))
    people = per_user.agg(F.count(F.lit(1)).alias("users"),
                          F.coalesce(F.sum("_buyer"), F.lit(0)).cast("long").alias("buyers"))
    aov = orders.agg(F.round(exact_mean(value), 2)).scalar()
    return people.select("users", "buyers", aov.alias("avg_order_value"))
