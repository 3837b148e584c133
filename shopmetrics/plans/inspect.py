"""Plan inspection, for tests and tuning: what physical operators a
DataFrame's plan holds (initial plan under AQE; the final one after it ran)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonUDF", "FlatMapGroupsInArrow", "MapInArrow")


def physical_plan(df: DataFrame) -> str:
    """The physical plan as text (``explain('formatted')`` form)."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def node_names(df: DataFrame) -> list[str]:
    """Operator names of the physical plan's tree, in print order."""
    tree = physical_plan(df).split("\n\n")[0].splitlines()[1:]
    return [m.group(1) for line in tree if (m := re.match(r"^[\s:+\-]*([A-Z][A-Za-z]+)", line))]


def count_nodes(df: DataFrame, name: str) -> int:
    return sum(1 for n in node_names(df) if n == name)


def has_python(df: DataFrame) -> bool:
    text = physical_plan(df)
    return any(n in text for n in PYTHON_NODES)


def plan_tree(df: DataFrame) -> list[tuple[int, str]]:
    """(depth, operator name) for each node of the physical plan tree."""
    tree = physical_plan(df).split("\n\n")[0].splitlines()[1:]
    out = []
    for line in tree:
        m = re.match(r"^([\s:+\-]*)([A-Z][A-Za-z]+)", line)
        if m:
            out.append((len(m.group(1)), m.group(2)))
    return out


def raw_shuffles(df: DataFrame) -> list[int]:
    """Positions of shuffle Exchanges that move scanned rows not yet aggregated.

    An ``Exchange`` whose subtree reaches a scan without passing another
    exchange must sit directly on a (partial) ``HashAggregate``; otherwise raw
    rows cross the network before any map-side reduction.
    """
    nodes = plan_tree(df)
    bad = []
    for i, (depth, name) in enumerate(nodes):
        if name != "Exchange":
            continue
        child = nodes[i + 1][1] if i + 1 < len(nodes) else ""
        reaches_scan = False
        for d, n in nodes[i + 1:]:
            if d <= depth:
                break
            if n in ("Exchange", "BroadcastExchange", "ReusedExchange"):
                reaches_scan = False
                break
            if n == "Scan":
                reaches_scan = True
                break
        if reaches_scan and child not in ("HashAggregate", "ObjectHashAggregate", "SortAggregate"):
            bad.append(i)
    return bad
