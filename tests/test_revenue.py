"""Revenue trend (O17-O19), segments (O20), order rollup (O26)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import revenue, segments
from tests.fixtures import as_dicts, events, orders


def _trend_inputs(spark):
    # trend_gaps: Jan has visits and no orders, Feb has both; Mar is missing;
    # Apr has orders and visits; May has orders but no visits; a repeated order id.
    ev = events(spark, [
        (1, 1, "home", "2024-01-03 10:00:00", "mobile", "Email"),
        (2, 2, "home", "2024-01-04 10:00:00", "mobile", "Email"),
        (3, 1, "home", "2024-02-03 10:00:00", "mobile", "Email"),
        (3, 1, "home", "2024-02-03 10:05:00", "mobile", "Email"),
        (4, 3, "cart", "2024-02-03 10:05:00", "mobile", "Email"),
        (5, 1, "home", "2024-04-01 10:00:00", "mobile", "Email"),
    ])
    od = orders(spark, [
        (10, 1, "Complete", 100.0, "2024-02-03 10:06:00"),
        (10, 1, "Complete", 100.0, "2024-02-03 10:06:00"),   # repeated id
        (11, 2, "Cancelled", 999.0, "2024-02-05 00:00:00"),
        (12, 1, "Shipped", 50.005, "2024-04-01 11:00:00"),
        (13, 2, "Returned", 75.0, "2024-04-02 11:00:00"),
        (14, 3, "Complete", 10.0, "2024-05-02 11:00:00"),
    ])
    return ev, od


def test_trend_gaps(spark):
    ev, od = _trend_inputs(spark)
    rows = as_dicts(revenue.revenue_trend(ev, od))
    months = [r["month"].strftime("%Y-%m") for r in rows]
    assert months == ["2024-01", "2024-02", "2024-04"]           # May (no visits) dropped
    jan, feb, apr = rows
    assert (jan["total_orders"], jan["unique_buyers"], jan["total_revenue"]) == (0, 0, 0.0)
    assert jan["visitor_conversion_pct"] == 0.0 and jan["mom_revenue_growth_pct"] is None
    assert feb["total_sessions"] == 1 and feb["unique_visitors"] == 1
    assert feb["total_orders"] == 1                               # distinct order ids
    assert feb["total_revenue"] == 200.0 and feb["avg_order_value"] == 100.0
    assert feb["mom_revenue_growth_pct"] is None                  # previous revenue is 0
    assert apr["mom_revenue_growth_pct"] == -37.5                 # vs previous *row* (Feb)
    assert apr["total_revenue"] == 125.01 and apr["unique_buyers"] == 2


def test_trend_export_and_summary(spark):
    ev, od = _trend_inputs(spark)
    ex = revenue.revenue_trend_export(ev, od)
    assert ex.columns == ["month", "unique_visitors", "total_revenue", "unique_buyers", "total_orders",
                          "avg_order_value", "conversion_pct", "month_str", "mom_growth"]
    rows = as_dicts(ex)
    assert [r["month_str"] for r in rows] == ["2024-01", "2024-02", "2024-04"]
    assert rows[2]["mom_growth"] == pytest.approx(100.0 * (125.005 - 200.0) / 200.0)   # prices are summed unrounded
    s = revenue.trend_summary(ex).first()
    assert s["total_revenue"] == 325.01
    assert s["peak_month"] == dt.datetime(2024, 2, 1)
    # buyers and visitors are independent sets: April has 2 buyers, 1 visitor
    assert [r["conversion_pct"] for r in rows] == [0.0, 100.0, 200.0]
    assert s["avg_conversion_pct"] == pytest.approx((0.0 + 100.0 + 200.0) / 3)


def test_trend_without_copies_equals_distinct_counts(spark):
    ev, od = _trend_inputs(spark)
    od = od.dropDuplicates(["order_id"])
    a = revenue.revenue_trend(ev, od).collect()
    b = revenue.revenue_trend(ev, od, order_id_unique=True, session_determines_user=True).collect()
    assert a == b and len(a) == 3
    c = revenue.revenue_trend(ev, od, session=["user_id", "session_id"], order_id_unique=True).collect()
    assert a == c                                                 # a session key of two columns


def test_period_without_timestamp_comes_last(spark):
    ev, od = _trend_inputs(spark)
    ev = ev.unionByName(events(spark, [(9, 9, "home", None, "mobile", "Email")]))
    rows = as_dicts(revenue.revenue_trend(ev, od))
    assert [r["month"] is None for r in rows] == [False, False, False, True]
    assert rows[0]["mom_revenue_growth_pct"] is None
    assert rows[-1]["total_revenue"] == 0.0 and rows[-1]["mom_revenue_growth_pct"] == -100.0
    export = as_dicts(revenue.revenue_trend_export(ev, od))
    assert export[-1]["month"] is None and export[-1]["mom_growth"] == -100.0


def test_trend_keeps_small_and_large_prices(spark):
    ev, _ = _trend_inputs(spark)
    od = orders(spark, [(1, 1, "Complete", 0.004, "2024-02-03 10:06:00"),
                        (2, 1, "Complete", 0.004, "2024-02-03 10:06:00"),
                        (3, 1, "Complete", 2e16, "2024-04-03 10:06:00")])
    rows = as_dicts(revenue.revenue_trend_export(ev, od))
    assert rows[1]["total_revenue"] == 0.008 and rows[1]["avg_order_value"] == 0.004
    assert rows[2]["total_revenue"] == 2e16
    rates = spark.createDataFrame([(1, 1.0, 0.004), (2, 1.0, 0.004)],
                                  "month INT, total_revenue DOUBLE, conversion_pct DOUBLE")
    assert revenue.trend_summary(rates).first()["avg_conversion_pct"] == 0.004


def test_hour_grain(spark):
    ev, od = _trend_inputs(spark)
    rows = as_dicts(revenue.revenue_trend(ev, od, grain="hour"))
    assert rows[0]["hour"] == dt.datetime(2024, 1, 3, 10)
    assert "hour" in revenue.revenue_trend(ev, od, grain="hour").columns


# The reference's published monthly trend (2023-01 .. 2024-12):
# visitors, revenue, buyers, orders, and its conversion and growth columns.
GOLDEN_TREND = [
    (164, 265.62, 2, 2, 1.22, None), (435, 645.2, 8, 8, 1.84, 142.9033958286274),
    (769, 722.31, 10, 10, 1.3, 11.951332920024793), (1054, 1155.23, 18, 18, 1.71, 59.93548476415944),
    (1363, 630.91, 14, 14, 1.03, -45.38663296486415), (1682, 2204.01, 38, 39, 2.26, 249.33825743766937),
    (2067, 2218.46, 32, 32, 1.55, 0.6556231596045459), (2254, 3073.78, 43, 43, 1.91, 38.55467306149312),
    (2619, 4017.91, 56, 56, 2.14, 30.715600986407598), (2871, 2923.22, 49, 49, 1.71, -27.24525935125476),
    (3122, 4553.61, 57, 57, 1.83, 55.77377002073056), (3636, 4246.26, 62, 62, 1.71, -6.749589885826834),
    (3798, 3673.25, 56, 56, 1.47, -13.49446336305361), (3662, 4131.57, 58, 58, 1.58, 12.477234057033959),
    (3875, 4831.49, 76, 76, 1.96, 16.940775540533014), (3881, 4529.48, 70, 70, 1.8, -6.2508667098555515),
    (4106, 5629.93, 71, 71, 1.73, 24.295283343783414), (4147, 4806.61, 65, 65, 1.57, -14.623982891439159),
    (4673, 6350.28, 88, 88, 1.88, 32.115565856185555), (5005, 4946.43, 75, 75, 1.5, -22.106899223341326),
    (5347, 7066.77, 101, 101, 1.89, 42.8660670422911), (6248, 7437.05, 110, 110, 1.76, 5.239734701992571),
    (7346, 9673.4, 141, 141, 1.92, 30.070390813561822), (7820, 12704.89, 180, 181, 2.3, 31.338412554014106),
]


def test_golden_trend(spark):
    ev_rows, od_rows = [], []
    oid = 0
    for m, (visitors, rev, buyers, n_orders, _, _) in enumerate(GOLDEN_TREND):
        day = dt.datetime(2023 + m // 12, m % 12 + 1, 1, 12)
        ev_rows += [(u, u, "home", day) for u in range(visitors)]
        cents = round(rev * 100)
        for j in range(n_orders):
            user = j if j < buyers else 0
            price = (cents - (n_orders - 1)) / 100 if j == 0 else 0.01
            od_rows.append((oid, user, "Complete", price, day))
            oid += 1
    ev = spark.createDataFrame(ev_rows, "session_id BIGINT, user_id BIGINT, event_type STRING, created_at TIMESTAMP_NTZ")
    od = orders(spark, od_rows)
    rows = as_dicts(revenue.revenue_trend_export(ev, od))
    assert len(rows) == 24
    for r, (visitors, rev, buyers, n_orders, conv, growth) in zip(rows, GOLDEN_TREND):
        assert (r["unique_visitors"], r["unique_buyers"], r["total_orders"]) == (visitors, buyers, n_orders)
        assert r["total_revenue"] == pytest.approx(rev, abs=1e-9)
        assert r["avg_order_value"] == pytest.approx(rev / n_orders, abs=1e-9)
        assert r["conversion_pct"] == conv
        assert (r["mom_growth"] is None) if growth is None else r["mom_growth"] == pytest.approx(growth, abs=1e-6)
    s = revenue.trend_summary(revenue.revenue_trend_export(ev, od)).first()
    assert s["total_revenue"] == 102437.67
    assert s["peak_month"] == dt.datetime(2024, 12, 1)


def test_tier_edges(spark):
    # tier_edges: 0, 0.01, 50, 50.01, 150, 400, 400.01 (right-closed; 0 has no tier)
    totals = [0.0, 0.01, 50.0, 50.01, 150.0, 400.0, 400.01]
    od = orders(spark, [(i, i, "Complete", v, "2024-01-01 00:00:00") for i, v in enumerate(totals)])
    rows = as_dicts(segments.spend_segments(od))
    assert [(r["segment"], r["customers"]) for r in rows] == [
        ("Low (<$50)", 2), ("Mid ($50-$150)", 2), ("High ($150-$400)", 1), ("VIP (>$400)", 1)]
    assert sum(r["revenue_share_pct"] for r in rows) == pytest.approx(100.0, abs=0.2)


def test_tiers_use_unrounded_spend_and_skip_missing(spark):
    od = orders(spark, [(1, 1, "Complete", 50.004, "2024-01-01 00:00:00"),
                        (2, 2, "Complete", 0.004, "2024-01-01 00:00:00"),
                        (3, 3, "Complete", 10.006, "2024-01-01 00:00:00"),
                        (4, 3, "Complete", 10.006, "2024-01-01 00:00:00"),
                        (5, 4, "Complete", None, "2024-01-01 00:00:00"),
                        (6, 5, "Complete", float("nan"), "2024-01-01 00:00:00"),
                        (7, 6, "Complete", None, "2024-01-01 00:00:00"),
                        (8, 6, "Complete", 1.0, "2024-01-01 00:00:00")])
    rows = as_dicts(segments.spend_segments(od))
    assert [(r["segment"], r["customers"]) for r in rows] == [("Low (<$50)", 3), ("Mid ($50-$150)", 1)]
    assert rows[1]["avg_spend"] == 50.004


# The reference's published tiers (customers, revenue) and shares.
GOLDEN_TIERS = [("Low (<$50)", 636, 636, 18228.27, 17.8), ("Mid ($50-$150)", 712, 724, 61894.29, 60.4),
                ("High ($150-$400)", 115, 122, 22315.11, 21.8)]


def test_golden_segments(spark):
    data, oid = [], 0
    for t, (_, customers, n_orders, rev, _) in enumerate(GOLDEN_TIERS):
        cents = round(rev * 100)
        each = cents // customers
        for c in range(customers):
            spend = each + (cents - each * customers if c == 0 else 0)
            parts = [spend] if c >= n_orders - customers else [spend // 2, spend - spend // 2]
            for p in parts:
                data.append((oid, t * 10**6 + c, "Shipped", p / 100, "2024-01-01 00:00:00"))
                oid += 1
    rows = as_dicts(segments.spend_segments(orders(spark, data)))
    assert [r["segment"] for r in rows] == [g[0] for g in GOLDEN_TIERS]
    for r, (_, customers, n_orders, rev, share) in zip(rows, GOLDEN_TIERS):
        assert r["customers"] == customers and r["total_revenue"] == rev and r["revenue_share_pct"] == share
        assert r["avg_spend"] == pytest.approx(rev / customers)
        assert r["avg_orders"] == pytest.approx(n_orders / customers)


def test_order_rollup(spark):
    items = spark.createDataFrame([(1, 10.1), (1, 20.2), (2, 5.0), (3, None)], "order_id BIGINT, sale_price DOUBLE")
    got = {r["order_id"]: (r["num_of_item"], r["total_sale_price"]) for r in revenue.order_rollup(items).collect()}
    assert got == {1: (2, 30.3), 2: (1, 5.0), 3: (1, None)}


def test_no_division_error_under_ansi(spark):
    ev, od = _trend_inputs(spark)
    assert spark.conf.get("spark.sql.ansi.enabled") in ("true", "True")
    revenue.revenue_trend(ev, od.where(F.lit(False))).collect()
