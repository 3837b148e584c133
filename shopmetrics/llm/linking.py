"""Links between near-equal items at any group size: shared by operators 1 and 6.

Items are nodes (one per distinct content, with a weight). A candidate search
gives star edges, never pairs; their components are clusters; inside a cluster
every pair is verified exactly. A cluster or bucket larger than a block is cut
into blocks, and every pair of blocks is a task of its own, so no group has to
fit one task. Tasks give one row per node (weight of its links, root of its
in-task component), so output grows with nodes and not with pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_arrow, written

BLOCK = 1000


def in_blocks(rows: DataFrame, key: str, node: str, size: str, block: int = BLOCK) -> DataFrame:
    """Rows once per task they take part in; ``size`` is the number of rows of their key.

    Adds ``_i``, ``_j`` (the pair of blocks) and ``_b`` (the row's own block).
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1),
                        lambda j: F.struct(F.least("_b", j).alias("i"), F.greatest("_b", j).alias("j")))
    return (rows.withColumn("_n", blocks).withColumn("_b", own).withColumn("_t", F.explode(pairs))
            .withColumn("_i", F.col("_t.i")).withColumn("_j", F.col("_t.j")).drop("_t", "_n", size)
            .withColumnRenamed(key, "_key"))


def map_groups(rows: DataFrame, fn: Callable[[pa.Table], dict[str, object] | None], schema: str) -> DataFrame:
    """``fn`` over the rows of every (``_key``, ``_i``, ``_j``), streamed from sorted partitions."""
    keys = ["_key", "_i", "_j"]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None
        done: list[pa.RecordBatch] = []

        def finish() -> None:
            out = fn(pa.Table.from_batches(waiting)) if sum(b.num_rows for b in waiting) > 1 else None
            waiting.clear()
            if out is not None:
                done.append(pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow],
                                                       schema=arrow))

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            changed = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                coded = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                changed[1:] |= coded[1:] != coded[:-1]
            first = tuple(c[0].as_py() for c in columns)
            if waiting and first != last:
                finish()
            starts = np.append(np.append(0, np.flatnonzero(changed)), batch.num_rows)
            starts = starts[1:] if starts[0] == starts[1] else starts
            for k in range(len(starts) - 1):
                if k:
                    finish()
                waiting.append(batch.slice(int(starts[k]), int(starts[k + 1] - starts[k])))
            last = tuple(c[batch.num_rows - 1].as_py() for c in columns)
            if done:
                yield from done
                done.clear()
        if waiting:
            finish()
        yield from done

    return map_arrow(rows.repartition(*keys).sortWithinPartitions(*keys, "node"), run, schema)


def task_pairs(group: pa.Table) -> np.ndarray:
    """Which pairs of a task's rows are its to compare: all of one block, or those across two."""
    n = group.num_rows
    own = np.ones((n, n), dtype=bool)
    if group.column("_i")[0].as_py() != group.column("_j")[0].as_py():
        b = group.column("_b").to_numpy()
        own = b[:, None] != b[None, :]
    np.fill_diagonal(own, False)
    return own


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row, the first row of its connected component."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def star_rows(group: pa.Table, linked: np.ndarray, weights: np.ndarray | None = None) -> dict[str, object] | None:
    """``node``, ``links`` (weight of its linked rows) and ``root`` for every row with a link.

    Rows come sorted by node, so a root is its component's smallest node: tasks
    that see parts of the same component mostly name the same root.
    """
    at = np.flatnonzero(linked.any(axis=1))
    if not len(at):
        return None
    nodes = group.column("node").combine_chunks()
    links = (linked[at] @ weights) if weights is not None else linked[at].sum(axis=1)
    return {"node": nodes.take(pa.array(at)), "links": links.astype(np.int64),
            "root": nodes.take(pa.array(roots(linked)[at]))}


STAR = "node binary, links long, root binary"


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, label)``: the smallest node each node of ``edges(node, root)`` is connected with.

    Labels spread over edges and then jump to their label's label; every round
    is a written table. Hot nodes meet only map-side combined minima and joins
    whose other side has one row per node.
    """
    both = written(edges.select("node", "root").union(edges.select("root", "node"))
                   .filter("node != root").distinct(), f"{name}-edges")
    labels = written(both.groupBy("node").agg(F.min("root").alias("m"))
                     .select("node", F.least("node", "m").alias("label")), f"{name}-labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("root"), "label"), "root")
                .groupBy("node").agg(F.min("label").alias("near")))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                  F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = written(spread.join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), f"{name}-labels")
        labels = step.select("node", "label")
        if step.filter("old != label").isEmpty():
            return labels


def link_clusters(stars: DataFrame, contents: Callable[[DataFrame], DataFrame],
                  verify: Callable[[pa.Table], np.ndarray], name: str, block: int = BLOCK) -> DataFrame:
    """``(node, links, label)`` of every node with a verified link.

    ``stars``: candidate edges (node, root). ``contents``: from ``(node,
    cluster)`` to the same with a weight and what ``verify`` needs to tell
    which rows of a group are linked.
    """
    clusters = components(stars, f"{name}-candidates")
    sizes = clusters.groupBy("label").agg(F.count("*").alias("_size"))
    members = clusters.join(sizes, "label").select("node", F.col("label").alias("cluster"), "_size")
    rows = contents(members)

    def check(group: pa.Table) -> dict[str, object] | None:
        linked = verify(group) & task_pairs(group)
        return star_rows(group, linked, group.column("weight").to_numpy())

    found = written(map_groups(in_blocks(rows, "cluster", "node", "_size", block), check, STAR), f"{name}-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found, f"{name}-classes")
    return counts.join(labels, "node")


def classes(base: DataFrame, nodes: DataFrame, linked: DataFrame, id_col: str) -> DataFrame:
    """One row per row of ``base(id, node)``: id, ``n_links``, ``class_id`` (smallest id of the class).

    ``nodes(node, first_id, weight)`` has one row per distinct content; a row
    without node links with nothing.
    """
    smallest = linked.join(nodes, "node").groupBy("label").agg(F.min("first_id").alias("_class"))
    known = linked.join(smallest, "label").select("node", "links", "_class")
    per_node = nodes.join(known, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("_class", "first_id").alias("class_id"))
    return base.join(per_node, "node", "left").select(
        id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_id", id_col).alias("class_id"))
