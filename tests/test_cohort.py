"""Cohorts (O06-O08): calendar offsets, validity, matrix filter, averages."""

import datetime as dt

from shopmetrics.operators import cohort
from tests.fixtures import as_dicts, orders


def _edges(spark):
    # cohort_edges: Jan 31 -> Mar 15 is offset 2; Dec -> Jan; offsets 11 and 12;
    # an only-cancelled user; a null status; two orders in one month.
    return orders(spark, [
        (1, 1, "Complete", 10.0, "2023-01-31 23:00:00"),
        (2, 1, "Shipped", 12.0, "2023-03-15 08:00:00"),
        (3, 1, "Returned", 5.0, "2023-12-01 00:00:00"),   # offset 11
        (4, 1, "Complete", 5.0, "2024-01-02 00:00:00"),   # offset 12: outside the horizon
        (5, 2, "Complete", 20.0, "2023-12-20 00:00:00"),
        (6, 2, "Complete", 20.0, "2024-01-05 00:00:00"),  # Dec -> Jan is offset 1
        (7, 2, "Complete", 25.0, "2024-01-25 00:00:00"),  # two orders in one month
        (8, 3, "Cancelled", 30.0, "2023-01-10 00:00:00"),
        (9, 4, None, 30.0, "2023-01-10 00:00:00"),
        (10, 5, "Complete", 9.0, "2023-01-05 00:00:00"),
        (11, None, "Complete", 9.0, "2023-01-06 00:00:00"),
    ])


def test_retention_offsets_and_sizes(spark):
    rows = as_dicts(cohort.cohort_retention(_edges(spark)))
    got = {(r["cohort_month"].strftime("%Y-%m"), r["month_number"]): (r["cohort_size"], r["retained_users"],
                                                                      r["retention_pct"]) for r in rows}
    assert got == {
        ("2023-01", 0): (2, 2, 100.0),
        ("2023-01", 2): (2, 1, 50.0),
        ("2023-01", 11): (2, 1, 50.0),
        ("2023-12", 0): (1, 1, 100.0),
        ("2023-12", 1): (1, 1, 100.0),
    }
    assert [(r["cohort_month"], r["month_number"]) for r in rows] == sorted(
        (r["cohort_month"], r["month_number"]) for r in rows)
    assert isinstance(rows[0]["cohort_month"], dt.datetime)


def test_matrix_and_average(spark):
    m = cohort.cohort_matrix(cohort.cohort_retention(_edges(spark)), min_months=3)
    assert m.columns == ["cohort_month"] + [str(i) for i in range(12)]
    rows = as_dicts(m)
    assert len(rows) == 1 and rows[0]["0"] == 100.0 and rows[0]["2"] == 50.0 and rows[0]["1"] is None
    m2 = cohort.cohort_matrix(cohort.cohort_retention(_edges(spark)), min_months=2)
    assert m2.count() == 2


# The reference's published cohort matrix (months 0..4; 8 and 9 are empty).
GOLDEN_MATRIX = [
    ("2023-12", [100.0, 1.6, None, 1.6, 1.6]),
    ("2024-05", [100.0, None, 1.4, None, 1.4]),
    ("2024-06", [100.0, 1.5, 1.5, None, None]),
]


def test_golden_cohort_average(spark):
    schema = "cohort_month STRING, " + ", ".join(f"`{i}` DOUBLE" for i in range(12))
    data = [(c, *(v + [None] * (12 - len(v)))) for c, v in GOLDEN_MATRIX]
    row = cohort.cohort_average(spark.createDataFrame(data, schema), months=(1, 3)).first()
    assert row["cohorts"] == 3
    assert abs(row["avg_month_1"] - 1.55) < 1e-9
    assert abs(row["avg_month_3"] - 1.6) < 1e-9
