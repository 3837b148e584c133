"""Mean and deviation of doubles of any size, the same whatever order rows come in.

A double is a whole number of 55 bits times a power of two. Rows are grouped by
that power (a few dozen groups in most data, some 2,100 at most; partial sums are
made where rows are read), and the whole numbers and their squares are summed in
three pieces of 19 bits, which is exact in 64 bits for up to 2 ** 44 rows a group (more
rows overflow, an error in ANSI mode). The groups' sums are then added in a fixed order with
their rounding errors carried along, so nothing cancels although one pass over the
table is enough. Everything is relative to the largest power: squares neither
overflow nor vanish.

NULL and NaN are missing values. An infinity makes the mean infinite and the
deviation NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.ratios import present_sql

ZERO = -1100  # the group of zeros, below every power of a double
HALF, LOW = 1 << 28, 1 << 48  # a whole number is split at HALF for its square, a sum at LOW for its two doubles
PIECE = 19  # bits of a piece of a summed number
SPLIT = 134217729.0  # 2 ** 27 + 1 cuts a double into two halves of 26 bits


def _scaled(x: str, power: str) -> str:
    """``x`` times two to a power that may be beyond the range of a double, in two exact steps."""
    return f"{x} * pow(2.0D, ({power}) div 2) * pow(2.0D, ({power}) - ({power}) div 2)"


def _pieces(x: str, name: str) -> list[Column]:
    """Sums of the pieces of a whole number of up to 57 bits; the sign is in the highest."""
    at = [f"({x}) & {(1 << PIECE) - 1}", f"shiftright({x}, {PIECE}) & {(1 << PIECE) - 1}", f"shiftright({x}, {2 * PIECE})"]
    return [F.expr(f"sum({p})").alias(f"{name}{i}") for i, p in enumerate(at)]


def _joined(name: str) -> str:
    at = [f"CAST({name}{i} AS DECIMAL(20,0)) * {1 << PIECE * i}" for i in range(3)]
    return f"({' + '.join(at)})"


def _added(terms: str) -> str:
    """The sum of an array of doubles as ``h`` and the rounding errors ``l`` left over."""
    return (f"aggregate({terms}, named_struct('h', 0.0D, 'l', 0.0D), (s, t) -> named_struct('h', s.h + t, 'l', s.l + "
            "CASE WHEN abs(s.h) >= abs(t) THEN (s.h - (s.h + t)) + t ELSE (t - (s.h + t)) + s.h END))")


def _halves(x: str) -> list[str]:
    high = f"({SPLIT}D * {x} - ({SPLIT}D * {x} - {x}))"
    return [f"{high} AS {x}_1", f"{x} - {high} AS {x}_2"]


def _product(a: str, b: str) -> list[str]:
    """The product of two doubles and its rounding error; both have been cut into halves."""
    return [f"{a} * {b}", f"(({a}_1 * {b}_1 - {a} * {b}) + {a}_1 * {b}_2 + {a}_2 * {b}_1) + {a}_2 * {b}_2"]


def spread(df: DataFrame, x: str) -> DataFrame:
    """One row, ``n, mean, std``: of the present values of a SQL operand; std is the sample deviation."""
    rows = df.selectExpr(f"{present_sql(x)} AS v").where("v IS NOT NULL").selectExpr(
        "v", "abs(v) = DOUBLE('Infinity') AS beyond",
        f"CASE WHEN v = 0 OR abs(v) = DOUBLE('Infinity') THEN {ZERO} ELSE CAST(floor(log2(abs(v))) AS INT) END AS e")
    # the usual powers by a shift, which is cheaper than pow
    near = "abs(v) * CAST(shiftleft(1L, 53 - e) AS DOUBLE)"
    whole = rows.selectExpr("v", "beyond", "e", f"CASE WHEN beyond THEN 0L WHEN e BETWEEN -9 AND 53 THEN CAST({near} AS BIGINT) "
                            f"ELSE CAST({_scaled('abs(v)', '53 - e')} AS BIGINT) END AS m")
    parts = whole.selectExpr("v", "beyond", "e", "CASE WHEN v < 0 THEN -m ELSE m END AS m",
                             f"shiftright(m, {HALF.bit_length() - 1}) AS a", f"m & {HALF - 1} AS b")
    sums = {"s": "m", "aa": "a * a", "ab": "a * b", "bb": "b * b"}
    bins = parts.groupBy("e").agg(F.count("*").alias("n"), F.expr("sum(CASE WHEN beyond THEN v END)").alias("beyond"),
                                  *[piece for k, x in sums.items() for piece in _pieces(x, k)])
    bins = bins.selectExpr("e", "n", "beyond", *[f"CAST({_joined(k)} div {LOW} AS DOUBLE) AS {k}_q" for k in sums],
                           *[f"CAST({_joined(k)} % {LOW} AS DOUBLE) AS {k}_r" for k in sums])
    fields = [f"{k}_{t}" for k in sums for t in "qr"]
    one = bins.agg(F.expr("CAST(coalesce(sum(n), 0) AS BIGINT) AS n"), F.expr("sum(beyond) AS beyond"), F.max("e").alias("top"),
                   F.array_sort(F.collect_list(F.struct("e", *fields))).alias("bins"))

    def terms(kinds: list[tuple[str, int, int]], times: int) -> str:
        at = [_scaled(f"{twice}.0D * b.{kind}_{part}", f"{times} * (b.e - top - 53) + {shift + more}")
              for kind, shift, twice in kinds for part, more in (("q", 48), ("r", 0))]
        return f"flatten(transform(bins, b -> array({', '.join(at)})))"

    count = "CAST(n AS DOUBLE)"
    one = one.selectExpr("n", "beyond", "top", f"{_added(terms([('s', 0, 1)], 1))} AS t1",
                         f"{_added(terms([('aa', 56, 1), ('ab', 28, 2), ('bb', 0, 1)], 2))} AS t2")
    one = one.selectExpr("n", "beyond", "top", "t2", "t1.l AS l", "t1.h AS h", f"{count} AS k",
                         f"(t1.h + t1.l) / nullif({count}, 0.0D) AS c")
    one = one.selectExpr("*", *_halves("c"), *_halves("h"), *_halves("k")).selectExpr(
        "*", f"{_product('c', 'c')[0]} AS p", f"{_product('c', 'c')[1]} AS p_rest")
    one = one.selectExpr("*", *_halves("p"))
    # squared distances to c: sum of squares - 2 c (sum) + n c^2
    ch, kp = _product("c", "h"), _product("k", "p")
    whole_sum = _added(f"array(t2.h, t2.l, -2.0D * ({ch[0]}), -2.0D * ({ch[1]}), -2.0D * c * l, {kp[0]}, {kp[1]}, k * p_rest)")
    one = one.selectExpr("n", "beyond", "top", "c", f"{whole_sum} AS d")
    return one.selectExpr(
        "n", f"CASE WHEN beyond IS NOT NULL THEN nanvl(beyond, NULL) ELSE {_scaled('c', 'top')} END AS mean",
        f"CASE WHEN beyond IS NULL THEN {_scaled('sqrt(greatest(d.h + d.l, 0.0D) / nullif(CAST(n - 1 AS DOUBLE), 0.0D))', 'top')} END AS std")


def mean_and_deviation(df: DataFrame, x: str) -> tuple[Column, Column]:
    """Mean and sample deviation of a SQL operand as scalar subqueries, from one pass over the table."""
    both = spread(df, x).select(F.struct("mean", "std").alias("both")).scalar()
    return both["mean"], both["std"]
