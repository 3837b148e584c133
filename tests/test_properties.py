"""Property tests: random small inputs against plain-Python brute force of the SQL semantics."""

import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shopmetrics.operators import cohort, funnel, segments
from tests.fixtures import orders

STAGES = ("home", "cart", "purchase")
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

event_rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)),          # user
                                st.sampled_from(["a", "b", None]),                 # dimension
                                st.sampled_from(STAGES + ("other",))),             # event type
                      min_size=0, max_size=30)


@SETTINGS
@given(event_rows)
def test_funnel_by_equals_distinct_counts(spark, rows):
    df = spark.createDataFrame(rows, "user_id BIGINT, traffic_source STRING, event_type STRING")
    got = {r["traffic_source"]: tuple(r[f"users_{s}"] for s in STAGES)
           for r in funnel.funnel_by(df, "traffic_source", stages=STAGES).collect()}
    users = defaultdict(lambda: defaultdict(set))
    dims = set()
    for u, d, e in rows:
        dims.add(d)
        if u is not None:
            users[d][e].add(u)
    assert got == {d: tuple(len(users[d][s]) for s in STAGES) for d in dims}


order_rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)),                         # user
                                st.sampled_from(["Complete", "Shipped", "Cancelled", None]),      # status
                                st.integers(0, 30),                                               # month index
                                st.integers(1, 28)),                                              # day
                      min_size=0, max_size=25)


@SETTINGS
@given(order_rows)
def test_cohort_retention_equals_self_join(spark, rows):
    data = [(i, u, s, 10.0, dt.datetime(2022 + m // 12, m % 12 + 1, d)) for i, (u, s, m, d) in enumerate(rows)]
    got = {(r["cohort_month"], r["month_number"]): (r["cohort_size"], r["retained_users"])
           for r in cohort.cohort_retention(orders(spark, data)).collect()}
    valid = [(u, t) for _, u, s, _, t in data if s in ("Complete", "Shipped", "Returned") and u is not None]
    first = {}
    for u, t in valid:
        m = dt.datetime(t.year, t.month, 1)
        first[u] = min(first.get(u, m), m)
    size = defaultdict(int)
    for u, c in first.items():
        size[c] += 1
    cells = defaultdict(set)
    for u, t in valid:
        c = first[u]
        n = (t.year - c.year) * 12 + t.month - c.month
        if 0 <= n <= 11:
            cells[(c, n)].add(u)
    assert got == {k: (size[k[0]], len(v)) for k, v in cells.items()}


spend_rows = st.lists(st.tuples(st.integers(0, 6), st.one_of(st.none(), st.integers(0, 60000))), min_size=0, max_size=20)


@SETTINGS
@given(spend_rows)
def test_spend_tiers_are_right_closed(spark, rows):
    data = [(i, u, "Complete", None if cents is None else cents / 100, dt.datetime(2024, 1, 1))
            for i, (u, cents) in enumerate(rows)]
    got = {r["segment"]: r["customers"] for r in segments.spend_segments(orders(spark, data)).collect()}
    totals = defaultdict(int)
    for u, cents in rows:
        totals[u] += cents or 0
    want = defaultdict(int)
    for cents in totals.values():
        for label, upper in zip(segments.DEFAULT_LABELS, (5000, 15000, 40000, None)):
            if cents > 0 and (upper is None or cents <= upper):
                want[label] += 1
                break
    assert got == dict(want)


visit_rows = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(0, 8)), max_size=25)  # user, session, month
trend_orders = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4), st.integers(0, 8), st.integers(0, 9999),
                                  st.sampled_from(["Complete", "Cancelled"])), max_size=20)  # id, user, month, cents, status


@SETTINGS
@given(visit_rows, trend_orders)
def test_revenue_trend_equals_brute_force(spark, visits, ords):
    def month(m):
        return dt.datetime(2024 + m // 12, m % 12 + 1, 1)
    ev = spark.createDataFrame([(s, u, "home", month(m)) for u, s, m in visits],
                               "session_id BIGINT, user_id BIGINT, event_type STRING, created_at TIMESTAMP_NTZ")
    od = orders(spark, [(i, u, st_, c / 100, month(m)) for i, u, m, c, st_ in ords])
    got = [(r["month"], r["total_sessions"], r["unique_visitors"], r["total_orders"], r["unique_buyers"],
            r["total_revenue"], r["mom_revenue_growth_pct"]) for r in revenue_trend_rows(ev, od)]
    want, prev = [], None
    for m in sorted({m for _, _, m in visits}):
        valid = [(i, u, c) for i, u, mm, c, s in ords if mm == m and s == "Complete"]
        rev = sum(c for _, _, c in valid)
        growth = None if prev in (None, 0) else round(100.0 * (rev / 100 - prev / 100) / (prev / 100), 1)
        want.append((month(m), len({s for _, s, mm in visits if mm == m}), len({u for u, _, mm in visits if mm == m}),
                     len({i for i, _, _ in valid}), len({u for _, u, _ in valid}), round(rev / 100, 2), growth))
        prev = rev
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-9
        assert (g[6] is None) == (w[6] is None) and (g[6] is None or abs(g[6] - w[6]) <= 0.1 + 1e-9)


def revenue_trend_rows(ev, od):
    from shopmetrics.operators import revenue
    return revenue.revenue_trend(ev, od).collect()
