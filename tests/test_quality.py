"""Data-quality checks and profiles (O09-O16, O22-O24)."""

from pyspark.sql import functions as F

from shopmetrics.operators import quality
from tests.fixtures import as_dicts, events, orders


def _null_events(spark):
    # quality_nulls: a null in each audited column
    return events(spark, [
        (1, 1, "home", "2024-01-01 00:00:00", "mobile", "Email"),
        (None, 2, "home", "2024-01-01 00:00:00", "mobile", "Email"),
        (2, None, "home", "2024-01-01 00:00:00", "mobile", "Email"),
        (3, 3, None, "2024-01-01 00:00:00", "mobile", "Email"),
        (4, 4, "home", None, "mobile", "Email"),
        (5, 5, "home", "2024-01-01 00:00:00", "mobile", None),
    ])


def _null_orders(spark):
    return orders(spark, [
        (1, None, "Complete", 1.0, "2024-01-01 00:00:00"),
        (2, 2, None, 2.0, "2024-01-01 00:00:00"),
        (3, 3, "Complete", None, "2024-01-01 00:00:00"),
        (4, 4, "Complete", 4.0, None),
    ])


def test_null_audit_union_positional_labels(spark):
    rows = as_dicts(quality.null_audit_union(_null_events(spark), _null_orders(spark)))
    assert rows[0] == dict(table_name="events", total_rows=6, null_user_id=1, null_session_id=1,
                           null_event_type=1, null_created_at=1, null_traffic_source=1)
    # orders: price nulls under null_session_id, status nulls under null_event_type, constant 0
    assert rows[1] == dict(table_name="orders", total_rows=4, null_user_id=1, null_session_id=1,
                           null_event_type=1, null_created_at=1, null_traffic_source=0)


def test_null_audit_union_on_empty_tables(spark):
    rows = as_dicts(quality.null_audit_union(_null_events(spark).where(F.lit(False)),
                                             _null_orders(spark).where(F.lit(False))))
    assert rows[0]["total_rows"] == 0 and rows[0]["null_user_id"] is None   # SUM over no rows
    assert rows[1]["null_traffic_source"] == 0


def test_null_audit_clean_form(spark):
    rows = as_dicts(quality.null_audit(_null_events(spark), "events"))
    assert {r["column_name"]: (r["null_count"], r["null_pct"]) for r in rows} == {
        "session_id": (1, 16.67), "user_id": (1, 16.67), "event_type": (1, 16.67),
        "created_at": (1, 16.67), "traffic_source": (1, 16.67)}
    assert quality.null_audit(_null_events(spark).where(F.lit(False)), "events").count() == 0


def _dups(spark):
    # quality_dups: pairs seen 1, 2, 3 times; a pair with a null session; > 20 tied pairs
    rows = [(1, 1, "home", "2024-01-01 00:00:00", "m", "E")]
    rows += [(2, 2, "home", "2024-01-01 00:00:00", "m", "E")] * 2
    rows += [(3, 3, "cart", "2024-01-01 00:00:00", "m", "E")] * 3
    rows += [(None, 4, "home", "2024-01-01 00:00:00", "m", "E")] * 2
    for s in range(100, 125):
        rows += [(s, s, "product", "2024-01-01 00:00:00", "m", "E")] * 2
    return events(spark, rows)


def test_duplicates_top_k_is_deterministic(spark):
    rows = as_dicts(quality.duplicate_keys(_dups(spark), limit=20))
    assert len(rows) == 20
    assert rows[0] == dict(session_id=3, event_type="cart", occurrences=3)
    assert rows[1] == dict(session_id=None, event_type="home", occurrences=2)   # null group kept, sorted first
    assert [r["session_id"] for r in rows[2:5]] == [2, 100, 101]
    assert quality.duplicate_key_count(_dups(spark)).first()["duplicate_pairs"] == 28
    assert quality.duplicate_keys(_dups(spark), limit=None).count() == 28


def test_orphans(spark):
    # quality_orphans: FK missing in parent; null FK; null PK in parent; duplicated PK in parent
    child = spark.createDataFrame([(1,), (2,), (2,), (None,), (9,)], "user_id BIGINT")
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "user_id BIGINT")
    assert quality.orphan_count(child, parent).first()["orphaned_event_rows"] == 2
    assert quality.orphan_count(child.where(F.lit(False)), parent).first()["orphaned_event_rows"] == 0


def test_stage_integrity(spark):
    ev = events(spark, [
        (1, 1, "purchase", "2024-01-01 00:00:00", "m", "E"),
        (2, 1, "cart", "2024-01-01 00:00:00", "m", "E"),
        (2, 1, "purchase", "2024-01-01 00:00:00", "m", "E"),
        (3, 1, "home", "2024-01-01 00:00:00", "m", "E"),
        (None, 1, "purchase", "2024-01-01 00:00:00", "m", "E"),
    ])
    assert quality.stage_integrity(ev).first()["sessions_with_purchase_no_cart"] == 2


def _prices(spark, values):
    return orders(spark, [(i, i, "Complete", v, "2024-01-01 00:00:00") for i, v in enumerate(values)])


def test_zscore_both_tails(spark):
    values = [50.0] * 40 + [1000.0, -900.0]
    rows = as_dicts(quality.zscore_outliers(_prices(spark, values)))
    assert [r["order_id"] for r in rows] == [40, 41]
    assert rows[0]["z_score"] > 3 and rows[1]["z_score"] < -3
    s = quality.outlier_summary(_prices(spark, values)).first()
    assert (s["total_rows"], s["outliers"], s["outlier_pct"]) == (42, 2, 4.8)


def test_zscore_degenerate(spark):
    # outlier_edges: all values equal (deviation 0) and a single row: no outlier, no error
    assert quality.zscore_outliers(_prices(spark, [5.0] * 10)).count() == 0
    assert quality.zscore_outliers(_prices(spark, [5.0])).count() == 0
    s = quality.outlier_summary(_prices(spark, [5.0])).first()
    assert s["outliers"] == 0 and s["std_value"] is None


def test_profiles(spark):
    ev = events(spark, [
        (1, 1, "home", "2024-01-01 00:00:00", "m", "E"),
        (1, 1, "purchase", "2024-01-01 00:00:00", "m", "E"),
        (2, 2, "home", "2024-01-01 00:00:00", "m", "S"),
        (3, None, "purchase", "2024-01-01 00:00:00", "m", "S"),
    ])
    od = _prices(spark, [10.0, 20.0, 30.01])
    p = quality.population_profile(ev, od).first()
    assert (p["users"], p["buyers"], p["avg_order_value"]) == (2, 1, 20.0)
    d = as_dicts(quality.value_distribution(ev, "event_type", normalize=True))
    assert [(r["event_type"], r["count"], r["share"]) for r in d] == [("home", 2, 0.5), ("purchase", 2, 0.5)]
    rc = {r["table_name"]: r["row_count"] for r in quality.row_counts({"events": ev, "orders": od}).collect()}
    assert rc == {"events": 4, "orders": 3}


def test_null_audit_union_lookup_equals_joined(spark):
    ev = _null_events(spark)
    users = spark.createDataFrame([(1, "Email"), (2, None), (3, "Search"), (4, "Search")],
                                  "user_id BIGINT, traffic_source STRING")
    joined = ev.drop("traffic_source").join(users, "user_id", "left")
    a = quality.null_audit_union(joined, _null_orders(spark)).collect()
    b = quality.null_audit_union(ev.drop("traffic_source"), _null_orders(spark), lookup=users,
                                 lookup_key="user_id").collect()
    assert a == b
    assert a[0]["null_traffic_source"] == 3     # user 2 (null source), null user, user 5 (no user row)
    empty = quality.null_audit_union(ev.drop("traffic_source").where(F.lit(False)), _null_orders(spark),
                                     lookup=users, lookup_key="user_id").first()
    assert empty["total_rows"] == 0 and empty["null_user_id"] is None


def test_merged_counts_equal_the_separate_ones(spark):
    tables = {"events": _null_events(spark), "orders": _null_orders(spark),
              "items": _null_orders(spark).where(F.lit(False))}
    counts = quality.null_and_row_counts(tables, ("events", "orders"))
    assert sorted(quality.row_counts_of(counts).collect()) == sorted(quality.row_counts(tables).collect())
    want = quality.null_audit_tables({k: tables[k] for k in ("events", "orders")})
    assert sorted(quality.nulls_of(counts).collect()) == sorted(want.collect())


def test_repeated_lookup_rows_multiply_nothing(spark):
    ev = _null_events(spark).drop("traffic_source")
    users = spark.createDataFrame([(1, "Email"), (1, "Search"), (2, "Email"), (3, "Search"), (3, "Search")],
                                  "user_id BIGINT, traffic_source STRING")
    rows = quality.null_audit_union(ev, _null_orders(spark), lookup=users, lookup_key="user_id").first()
    assert rows["total_rows"] == 6


def test_weighted_distribution(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2)], "v STRING, n BIGINT")
    rows = quality.value_distribution(df, "v", normalize=True, weight="n").collect()
    assert [tuple(r) for r in rows] == [("a", 5, 0.833), ("b", 1, 0.167)]


def test_missing_values_are_no_outliers(spark):
    values = [50.0] * 40 + [1000.0, -900.0]
    want = as_dicts(quality.zscore_outliers(_prices(spark, values)))
    odd = _prices(spark, values + [float("nan"), None])
    assert as_dicts(quality.zscore_outliers(odd)) == want
    a, b = (quality.outlier_summary(df).first().asDict() for df in (_prices(spark, values), odd))
    assert b.pop("total_rows") == 44 and a.pop("total_rows") == 42
    assert (b.pop("outlier_pct"), a.pop("outlier_pct")) == (4.5, 4.8) and a == b
    nothing = quality.outlier_summary(_prices(spark, [float("nan")] * 5)).first()
    assert (nothing["outliers"], nothing["mean_value"], nothing["std_value"]) == (0, None, None)
    huge = quality.outlier_summary(_prices(spark, [1.0] * 50 + [float("inf")])).first()
    assert huge["outliers"] == 0 and huge["mean_value"] == float("inf")


def test_mean_and_deviation_are_bit_equal_in_any_partitions(spark):
    import random
    import statistics

    from shopmetrics.functions.exact import mean_and_deviation

    rng = random.Random(3)
    values = [rng.choice([1, -1]) * rng.random() * 10 ** rng.choice([-300, -9, -3, 0, 2, 7, 20]) for _ in range(4000)]
    df = _prices(spark, values)
    seen = set()
    for n in (1, 3, 7, 16):
        mean, std = mean_and_deviation(df.repartition(n, F.rand(n)), "total_sale_price")
        seen.add(tuple(spark.range(1).select(mean, std).first()))
    assert len(seen) == 1
    mean, std = seen.pop()
    assert abs(mean / statistics.fmean(values) - 1) < 1e-12 and abs(std / statistics.stdev(values) - 1) < 1e-12
    small = _prices(spark, [0.1, 0.2, 0.3])
    mean, std = spark.range(1).select(*mean_and_deviation(small, "total_sale_price")).first()
    assert (mean, std) == (0.2, 0.1) or (abs(mean - 0.2) < 1e-16 and abs(std - 0.1) < 1e-16)
