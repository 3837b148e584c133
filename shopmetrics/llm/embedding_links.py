"""Operator 6: embedding near-dedup by collision-counting projections.

Vectors are scaled to unit length; equal vectors are one node. Many random
one-dimensional projections are taken. Some of them, in groups of ``keys``,
are cut into ranges (randomly shifted): vectors that share all ranges of a
group meet in a bucket. In a bucket, every counting projection is sorted, a
window is centred on each vector, and a pair scores a collision wherever one
lies in the other's window. Pairs with at least the recall-calibrated number
of collisions are candidates: they become star edges, their components
clusters, and all pairs of a cluster are verified by cosine in double
precision (``linking``).

Only a node's digest and its counting projections, one byte each, travel to
its buckets; the vectors themselves meet in clusters of candidates alone.
Rounding to steps widens a window, so it loses no collision. Collisions are
counted over the first half of the projections, and over the second half for
rows that still have a candidate.

``groups_for`` gives the number of groups at which a pair at the threshold
meets with the target probability. ``keys`` grows with the logarithm of the
number of nodes, so buckets of unrelated vectors keep their size as data grow.

A vector that is null, zero, or holds a null or non-finite component links
with nothing, as does a row without id (component null). Repeated rows are
linked copies. Vectors of another length than the first are compared only with
their like.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches, written
from .linking import BLOCK, STAR, classes, in_blocks, link_clusters, map_groups, star_rows, task_pairs

COSINE = 0.95
RECALL = 0.999
RANGE = 2.0  # width of a key range; projections of unit vectors have deviation 1
COUNTING = 48  # counting projections
FIRST = 24  # of them, counted for every pair of a bucket
BUCKET = 200  # unrelated vectors wanted in a bucket


def distance(cosine: float) -> float:
    """Euclidean distance of unit vectors: the deviation of their projections' difference."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_range(cosine: float) -> float:
    """Probability that a pair shares one randomly shifted range."""
    r = RANGE / max(distance(cosine), 1e-9)
    return 1 - 2 * normal_cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def keys_for(nodes: int, most: int) -> int:
    """Projections in a group, so that a bucket holds about ``BUCKET`` unrelated vectors."""
    return max(1, min(most, math.ceil(math.log(max(1.0, nodes / BUCKET)) / -math.log(same_range(0.0)))))


def groups_for(cosine: float, recall: float, keys: int) -> int:
    met = same_range(cosine) ** keys
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def window_for(cosine: float) -> float:
    """Half-width of a query-centred window: a pair at the threshold collides with about 0.87."""
    return 1.5 * distance(cosine)


def step_for(cosine: float) -> float:
    """Width of a step of a counting projection: 127 steps reach four deviations or more."""
    return max(window_for(cosine) / 15, 4 / 127)


def least_collisions(cosine: float, recall: float, projections: int = COUNTING) -> int:
    """The largest count that a pair at the threshold reaches with the target recall (binomial).

    Windows grow with the distance at the threshold, so it is the same for every cosine.
    """
    p = 2 * normal_cdf(1.5) - 1
    reached = 1.0
    for k in range(projections + 1):
        reached -= math.comb(projections, k) * p ** k * (1 - p) ** (projections - k)
        if reached < recall:
            return k
    return projections


@cache
def directions(dim: int, many: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, many))


@cache
def shifts(many: int) -> np.ndarray:
    return np.random.default_rng(99).random(many) * RANGE


def unit_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None where a vector links with nothing."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        if not v or None in v:
            out.append(None)
            continue
        x = np.array(v, dtype=np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top  # squares of very small or large components stay in range
        out.append(x / math.sqrt(float(x @ x)))
    return out


def steps(x: np.ndarray, cosine: float) -> np.ndarray:
    """The counting projections of unit vectors in whole steps, a byte each."""
    places = np.floor(x @ directions(x.shape[1], COUNTING, 1) / step_for(cosine))
    return np.clip(places, -127, 127).astype(np.int8)


def half_window(cosine: float) -> int:
    """Half-width of a window in steps: places round down, so it grows by a step."""
    return int(window_for(cosine) / step_for(cosine)) + 1


def collisions(x: np.ndarray, cosine: float) -> np.ndarray:
    """For every pair of unit vectors, in how many counting projections one lies in the other's window."""
    return counted(steps(x, cosine).T, half_window(cosine))


def counted(lines: np.ndarray, half: int) -> np.ndarray:
    """Collisions of every pair of columns over the projections, one a row."""
    n = lines.shape[1]
    lines = lines.astype(np.int16)
    if n <= 48:  # sorting would cost more than it saves
        return (np.abs(lines[:, :, None] - lines[:, None, :]) <= half).sum(axis=0, dtype=np.uint8)
    count = np.zeros((n, n), dtype=np.uint8)
    for p in lines:
        order = np.argsort(p, kind="stable")
        line = p[order]
        low = np.searchsorted(line, line - np.int16(half), "left").astype(np.uint16)
        width = np.searchsorted(line, line + np.int16(half), "right").astype(np.uint16) - low
        place = np.empty(n, dtype=np.uint16)  # tasks hold two blocks at most
        place[order] = np.arange(n, dtype=np.uint16)
        # unsigned: a place before the window's start wraps to a large number
        count += place[None, :] - low[place][:, None] < width[place][:, None]
    return count


def candidates(places: np.ndarray, cosine: float, recall: float) -> np.ndarray:
    """Which pairs of rows of ``steps`` reach the calibrated counts of collisions."""
    half = half_window(cosine)
    lines = np.ascontiguousarray(places.T)
    count = counted(lines[:FIRST], half)
    near = count >= least_collisions(cosine, recall, FIRST)
    np.fill_diagonal(near, False)
    at = np.flatnonzero(near.any(axis=1))
    if len(at):
        both = np.ix_(at, at)
        near[both] &= count[both] + counted(lines[FIRST:, at], half) >= least_collisions(cosine, recall)
    return near


def vectors(group: pa.Table, column: str = "unit", kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(group.column(column).to_pylist()), dtype=kind).reshape(group.num_rows, -1)


def embedding_links(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Per row: id, ``n_links``, ``class_id`` (smallest id reachable by links)."""
    kind = embeddings.schema[id_col].dataType.simpleString()

    def scale(batch: pa.RecordBatch) -> dict[str, object]:
        found = [None if v is None else v.tobytes() for v in unit_vectors(batch.column(1))]
        return {id_col: batch.column(0), "node": [None if u is None else xxhash.xxh3_128_digest(u) for u in found],
                "unit": found}

    base = written(map_batches(embeddings.select(id_col, vector_col).filter(F.col(id_col).isNotNull()), scale,
                               f"`{id_col}` {kind}, node binary, unit binary"), "vectors")
    nodes = written(base.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(id_col).alias("first_id"), F.count("*").alias("weight"), F.first("unit").alias("unit")), "vector-nodes")
    keys = keys_for(nodes.count(), 24)
    groups = groups_for(cosine, recall, keys)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                raw = part.column(1).to_pylist()
                sizes = np.array([len(r) // 8 for r in raw])
                for dim in np.unique(sizes):  # vectors of one length at a time
                    rows = np.flatnonzero(sizes == dim)
                    x = np.frombuffer(b"".join(raw[r] for r in rows), dtype="<f8").reshape(len(rows), dim)
                    cell = np.floor((x @ directions(int(dim), keys * groups, 2) + shifts(keys * groups)) / RANGE)
                    cell = cell.astype(np.int64).reshape(len(rows), groups, keys)
                    cell = np.concatenate([np.broadcast_to(np.array([0, int(dim)]), (len(rows), groups, 2)), cell], 2)
                    cell = np.ascontiguousarray(cell)
                    cell[:, :, 0] = np.arange(groups)
                    bucket = [xxhash.xxh3_64_intdigest(c) for c in cell.reshape(-1, keys + 2)]
                    row = pa.array(np.repeat(rows, groups))
                    each = pa.array(np.repeat(np.arange(len(rows)), groups))
                    places = pa.array([v.tobytes() for v in steps(x, cosine)]).take(each)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(row), places, pa.array(np.array(bucket, dtype=np.uint64).view(np.int64))],
                        ["node", "places", "bucket"])

    spread = written(map_arrow(nodes.select("node", "unit"), ranges, "node binary, places binary, bucket long"),
                     "vector-buckets")
    # written, so that Spark knows the size of the few large buckets when it plans the join with them
    large = written(spread.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK),
                    "vector-large-buckets")
    met = spread.join(large, "bucket", "left").withColumn("size", F.coalesce("size", F.lit(1)))

    def count(group: pa.Table) -> dict[str, object] | None:
        return star_rows(group, candidates(vectors(group, "places", "i1"), cosine, recall) & task_pairs(group))

    stars = written(map_groups(in_blocks(met, "bucket", "node", "size"), count, STAR).filter("node != root"),
                    "vector-candidates")

    def contents(members: DataFrame) -> DataFrame:
        return members.join(nodes.select("node", "weight", "unit"), "node")

    def verify(group: pa.Table) -> np.ndarray:
        x = vectors(group)
        return x @ x.T >= cosine

    linked = link_clusters(stars, contents, verify, "vectors")
    found = classes(base.select(id_col, "node"), nodes.select("node", "first_id", "weight"), linked, id_col)
    lost = embeddings.select(id_col).filter(F.col(id_col).isNull())
    return found.unionByName(lost.select(id_col, F.lit(0).cast("long").alias("n_links"),
                                         F.lit(None).cast(found.schema["class_id"].dataType).alias("class_id")))
