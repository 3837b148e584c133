"""Funnels (O01-O05): edge fixtures, invariants and golden arithmetic."""

from pyspark.sql import functions as F

from shopmetrics.operators import funnel
from tests.fixtures import as_dicts, events

STAGES = ("home", "category", "product", "cart", "purchase")


def _gaps(spark):
    # funnel_gaps: purchase without cart; repeated events; an unknown event type;
    # a null user; a source with no home event; a source whose users are all null.
    return events(spark, [
        (1, 1, "home", "2024-01-01 10:00:00", "mobile", "Email"),
        (1, 1, "home", "2024-01-01 10:01:00", "mobile", "Email"),
        (1, 1, "category", "2024-01-01 10:02:00", "mobile", "Email"),
        (1, 1, "purchase", "2024-01-01 10:03:00", "mobile", "Email"),
        (2, 2, "home", "2024-01-01 11:00:00", "desktop", "Email"),
        (2, 2, "wishlist", "2024-01-01 11:01:00", "desktop", "Email"),
        (3, None, "home", "2024-01-01 12:00:00", "desktop", "Email"),
        (4, 3, "category", "2024-01-02 09:00:00", "tablet", "Search"),
        (5, None, "home", "2024-01-02 09:30:00", "tablet", "Display"),
    ])


def test_overall_counts_are_open_and_distinct(spark):
    row = as_dicts(funnel.funnel_overall(_gaps(spark), stages=STAGES))[0]
    assert [row[f"stage_{i + 1}_{s}"] for i, s in enumerate(STAGES)] == [2, 2, 0, 0, 1]
    assert row["pct_home_to_category"] == 100.0
    assert row["pct_category_to_product"] == 0.0
    assert row["pct_product_to_cart"] is None          # zero denominator -> NULL
    assert row["pct_cart_to_purchase"] is None
    assert row["overall_conversion_rate_pct"] == 50.0


def test_overall_on_empty_input_gives_zeros(spark):
    empty = _gaps(spark).where(F.lit(False))
    row = as_dicts(funnel.funnel_overall(empty, stages=STAGES))[0]
    assert [row[f"stage_{i + 1}_{s}"] for i, s in enumerate(STAGES)] == [0] * 5
    assert row["overall_conversion_rate_pct"] is None


def test_by_source_keeps_sources_without_units(spark):
    rows = {r["traffic_source"]: r for r in as_dicts(funnel.funnel_by(_gaps(spark), "traffic_source", stages=STAGES))}
    assert set(rows) == {"Email", "Search", "Display"}
    assert rows["Display"]["users_home"] == 0           # all its users are null
    assert rows["Search"]["users_home"] == 0 and rows["Search"]["users_category"] == 1
    assert rows["Search"]["overall_conversion_pct"] is None
    assert rows["Email"]["users_home"] == 2 and rows["Email"]["users_purchase"] == 1
    order = [r["traffic_source"] for r in as_dicts(funnel.funnel_by(_gaps(spark), "traffic_source", stages=STAGES))]
    assert order == ["Email", "Display", "Search"]      # NULL rates last, then by name


def test_device_overlap_counts_user_under_each_device(spark):
    ev = events(spark, [
        (1, 7, "home", "2024-01-01 10:00:00", "mobile", "Email"),
        (2, 7, "home", "2024-01-02 10:00:00", "desktop", "Email"),
        (2, 7, "product", "2024-01-02 10:01:00", "desktop", "Email"),
    ])
    rows = {r["device_type"]: r for r in as_dicts(funnel.funnel_by_device(ev, stages=STAGES))}
    assert rows["mobile"]["users_home"] == 1 and rows["desktop"]["users_home"] == 1
    assert rows["desktop"]["pct_reached_product"] == 100.0   # product over home, skipping category
    assert rows["mobile"]["pct_reached_product"] == 0.0
    assert rows["desktop"]["pct_product_to_cart"] == 0.0


def test_lookup_path_equals_joined_path(spark):
    ev = _gaps(spark).drop("traffic_source")
    users = spark.createDataFrame([(1, "Email"), (2, "Search"), (3, "Search")], "user_id BIGINT, traffic_source STRING")
    joined = ev.join(users, "user_id", "left")
    a = sorted(map(tuple, funnel.funnel_by(joined, "traffic_source", stages=STAGES).collect()), key=str)
    b = sorted(map(tuple, funnel.funnel_by(ev, "traffic_source", stages=STAGES, lookup=users,
                                           lookup_key="user_id", unit_determines_key=True).collect()), key=str)
    c = sorted(map(tuple, funnel.funnel_by(ev, "traffic_source", stages=STAGES, lookup=users,
                                           lookup_key="user_id").collect()), key=str)
    assert a == b == c


def _golden_events(spark, counts, source=None):
    """Users 0..counts[0]-1 reach stage i when their id < counts[i] (nested funnel)."""
    frames = [spark.range(n).select(F.col("id").alias("user_id"), F.lit(s).alias("event_type"))
              for s, n in zip(STAGES, counts)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("traffic_source", F.lit(source)) if source else out


# The reference's published stage counts (overall and per source)
# and the rates printed next to them.
GOLDEN_OVERALL = (50000, 24178, 15613, 3041, 1655)
GOLDEN_FROM_TOP = (100.0, 48.4, 31.2, 6.1, 3.3)
GOLDEN_DROP_OFF = (None, 51.6, 35.4, 80.5, 45.6)
GOLDEN_SOURCES = {
    "Email": ((8984, 4380, 2895, 570, 393), 4.37, 68.9),
    "Organic": ((14997, 7234, 4628, 916, 583), 3.89, 63.6),
    "Search": ((13982, 6736, 4333, 814, 428), 3.06, 52.6),
    "Facebook": ((7532, 3644, 2371, 463, 178), 2.36, 38.4),
    "Display": ((4505, 2184, 1386, 278, 73), 1.62, 26.3),
}


def test_golden_funnel_long(spark):
    rows = as_dicts(funnel.funnel_long(_golden_events(spark, GOLDEN_OVERALL), stages=STAGES,
                                       labels=funnel.DEFAULT_LABELS).orderBy("stage_no"))
    assert [r["users"] for r in rows] == list(GOLDEN_OVERALL)
    assert tuple(r["conversion_from_top_pct"] for r in rows) == GOLDEN_FROM_TOP
    assert tuple(r["drop_off_pct"] for r in rows) == GOLDEN_DROP_OFF
    assert rows[2]["stage"] == "Product\nView"
    # drop-off + proceed = 100 (within rounding)
    over = as_dicts(funnel.funnel_overall(_golden_events(spark, GOLDEN_OVERALL), stages=STAGES))[0]
    for i in range(1, 5):
        assert abs(rows[i]["drop_off_pct"] + over[f"pct_{STAGES[i - 1]}_to_{STAGES[i]}"] - 100) <= 0.1


def test_golden_sources_compact(spark):
    ev = None
    for i, (src, (counts, _, _)) in enumerate(GOLDEN_SOURCES.items()):
        f = _golden_events(spark, counts, src).withColumn("user_id", F.col("user_id") + i * 10**6)
        ev = f if ev is None else ev.unionByName(f)
    rows = as_dicts(funnel.funnel_by_compact(ev, "traffic_source", stages=STAGES))
    assert [r["traffic_source"] for r in rows] == list(GOLDEN_SOURCES)
    for r in rows:
        counts, conv, c2p = GOLDEN_SOURCES[r["traffic_source"]]
        assert tuple(r[s] for s in STAGES) == counts
        assert r["conversion_pct"] == conv and r["cart_to_purchase_pct"] == c2p
    # per-source counts add up to the overall ones (source is a user property)
    totals = ev.agg(*[F.count_distinct(F.when(F.col("event_type") == s, F.col("user_id"))).alias(s) for s in STAGES])
    assert tuple(totals.first()) == GOLDEN_OVERALL


def test_two_phase_equals_count_distinct(spark):
    ev = _gaps(spark)
    ours = {r["traffic_source"]: tuple(r[f"users_{s}"] for s in STAGES)
            for r in as_dicts(funnel.funnel_by(ev, "traffic_source", stages=STAGES))}
    direct = ev.groupBy("traffic_source").agg(
        *[F.count_distinct(F.when(F.col("event_type") == s, F.col("user_id"))).alias(s) for s in STAGES])
    assert ours == {r[0]: tuple(r[1:]) for r in direct.collect()}


def test_round_ties_half_up(spark):
    # round_ties: 1 of 16 -> 6.25 -> 6.3; 1 of 400 -> 0.25 -> 0.3
    for n, want in ((16, 6.3), (400, 0.3)):
        ev = _golden_events(spark, (n, 1, 0, 0, 0))
        row = as_dicts(funnel.funnel_overall(ev, stages=STAGES))[0]
        assert row["pct_home_to_category"] == want


def test_lookup_with_sessions_regroups_per_key(spark):
    # unit = session, key = user: flags are summed per user before the join
    ev = events(spark, [
        (1, 1, "home", "2024-01-01 10:00:00", "m", None),
        (2, 1, "home", "2024-01-02 10:00:00", "m", None),
        (2, 1, "purchase", "2024-01-02 10:05:00", "m", None),
        (3, 2, "home", "2024-01-02 11:00:00", "m", None),
        (4, None, "home", "2024-01-03 11:00:00", "m", None),
        (None, 3, "home", "2024-01-03 12:00:00", "m", None),
    ]).drop("traffic_source")
    users = spark.createDataFrame([(1, "Email"), (2, "Search")], "user_id BIGINT, traffic_source STRING")
    joined = ev.join(users, "user_id", "left")
    want = {r["traffic_source"]: tuple(r[f"users_{s}"] for s in STAGES)
            for r in funnel.funnel_by(joined, "traffic_source", unit="session_id", stages=STAGES).collect()}
    got = {r["traffic_source"]: tuple(r[f"users_{s}"] for s in STAGES)
           for r in funnel.funnel_by(ev, "traffic_source", unit="session_id", stages=STAGES, lookup=users,
                                     lookup_key="user_id", unit_determines_key=True).collect()}
    assert got == want
    assert want["Email"][0] == 2 and want["Email"][4] == 1 and want[None][0] == 1   # session 4; null session skipped


def test_repeated_lookup_rows_multiply_nothing(spark):
    ev = events(spark, [(1, 1, "home", "2024-01-01 00:00:00", "m", None)])
    users = spark.createDataFrame([(1, "Email"), (1, "Search")], "user_id BIGINT, traffic_source STRING")
    for exact in (True, False):
        rows = funnel.funnel_by(ev.drop("traffic_source"), "traffic_source", lookup=users, lookup_key="user_id",
                                unit_determines_key=exact).collect()
        assert [(r["traffic_source"], r["users_home"]) for r in rows] == [("Email", 1)]


def test_unit_of_several_columns(spark):
    ev = events(spark, [(1, 1, "home", "2024-01-01 00:00:00", "m", "E"),
                        (1, 2, "home", "2024-01-01 00:00:00", "m", "E"),
                        (1, 2, "purchase", "2024-01-01 00:00:00", "m", "E"),
                        (None, 2, "home", "2024-01-01 00:00:00", "m", "E")])
    row = funnel.funnel_overall(ev, unit=("user_id", "session_id")).first()
    assert row["stage_1_home"] == 2 and row["stage_5_purchase"] == 1
    by = funnel.funnel_by(ev, "traffic_source", unit=("user_id", "session_id")).first()
    assert by["users_home"] == 2 and by["users_purchase"] == 1


def test_overall_rows_from_per_source_counts(spark):
    ev = events(spark, [(1, 1, "home", "2024-01-01 00:00:00", "m", "E"),
                        (2, 2, "home", "2024-01-01 00:00:00", "m", "S"),
                        (2, 2, "cart", "2024-01-01 00:00:00", "m", "S"),
                        (3, 3, "home", "2024-01-01 00:00:00", "m", None)])
    counts = funnel.stage_counts(ev, ["traffic_source"], "user_id", funnel.DEFAULT_STAGES)
    got = funnel.long_rows(counts.agg(*funnel.stage_totals(funnel.DEFAULT_STAGES))).collect()
    assert got == funnel.funnel_long(ev).collect()


def test_several_funnels_from_one_pass(spark):
    seen = [(1, "home", "m"), (1, "home", "d"), (1, "cart", "d"), (2, "home", "m"), (2, "purchase", "m"), (3, "home", None),
            (3, "category", None), (None, "home", "t"), (4, "product", "m"), (4, "home", "m"), (6, "home", "m")]
    ev = events(spark, [(s, s and s % 5, t, "2024-01-01 00:00:00", d, None) for s, t, d in seen]).drop("traffic_source")
    users = spark.createDataFrame([(1, "Email"), (2, "Search"), (3, None)], "user_id BIGINT, traffic_source STRING")
    got = funnel.funnel_dimensions(ev, ["traffic_source", "device_type"], "session_id", lookup=users, lookup_key="user_id")
    rows = [tuple(r) for r in got.collect()]
    joined = ev.join(users, "user_id", "left")
    for dim in ("traffic_source", "device_type"):
        want = [tuple(r) for r in funnel.funnel_by(joined, dim, "session_id").collect()]
        assert sorted((r[1:] for r in rows if r[0] == dim), key=str) == sorted(want, key=str)
    whole = tuple(funnel.funnel_overall(ev, "session_id").first())
    assert [r[2:] for r in rows if r[0] == "overall"] == [whole]
    no_overall = funnel.funnel_dimensions(ev, ["device_type"], "session_id", overall=False)
    assert {r["dimension"] for r in no_overall.collect()} == {"device_type"}


def test_several_funnels_read_events_once(spark, tmp_path):
    from shopmetrics.plans.inspect import node_names

    ev = events(spark, [(1, 1, "home", "2024-01-01 00:00:00", "m", "Email")])
    ev.write.parquet(f"{tmp_path}/ev")
    nodes = node_names(funnel.funnel_dimensions(spark.read.parquet(f"{tmp_path}/ev"), ["traffic_source", "device_type"]))
    assert nodes.count("Scan") == 1 and nodes.count("Expand") == 1
    assert "HashAggregate" in nodes[nodes.index("Expand"):]  # only reduced rows are copied
