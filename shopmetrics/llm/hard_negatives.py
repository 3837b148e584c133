"""Operator 13: hard negatives by cover trees over norm-augmented vectors.

With ``M`` the largest squared norm, a vector x gets one more component,
``sqrt(M - |x|^2)``, so that all lie on one sphere; a query q (its added component
0) is nearest to those of the largest inner product. Steps:

1. Rows of equal label and vector are one point with its ``KEEP`` smallest ids;
   as ties go by id, no further one can be among the first five.
2. **Top level.** Centres taken farthest-first from a bounded sample; every
   point joins its nearest centre's cell. The covering radius of a cell, by
   group of labels, is the largest distance in it, over all points.
3. **Lower levels.** Cells are cut into blocks of at most about ``BLOCK`` points
   and each block becomes a cover tree in the task that searches it: a ball is
   covered by centres more than half its radius apart, each with its own covering
   radius, until few points or one place are left.
4. **Search.** A ball is a cap of the sphere. With ``a`` the angle of q and its
   centre and ``w`` that of its covering radius, it holds inner products from
   ``|q| sqrt(M) cos(a + w)`` to ``|q| sqrt(M) cos(a - w)`` (angles kept from 0 to a
   half turn). Balls wholly outside every window of a query, or below what it has
   found, are skipped - whole cells before anything is sent to them,
   then balls in order of their upper bound. What is left is verified by exact
   inner products. A query first goes to the best cell of each group; what it finds
   there is the bound for all others. Queries of one block are cut into slices,
   each a task of its own with a copy of the block.

The result is exact, not approximate, while squared norms stay below 2 ** 53 (larger
products are compared as doubles). Rows with a null label, a null vector, a
null or non-finite component, or one that scaling makes infinite, take no part,
nor do rows without id. Vectors meet only vectors of their own length. Rows
repeated whole count once; rows that share an id but differ each take part, and
rows with an anchor's own id are not among its others. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fit_in_task, map_arrow, map_batches, written

SAMPLE = 4096  # points from which the top level's centres are taken
CENTRES = 1024  # centres at most
BLOCK = 4096  # points of a block, about
SLICE = 4096  # queries of a slice, about
GROUPS = 64  # groups of labels
LEAF = 32  # points of a ball that is not split further
FAR = 1 << 62  # beyond any score
HIT = "query binary, place int, score long, id long"


def vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """``(id, label, vec, grp)`` of usable rows: components as doubles, scaled and floored; rows repeated whole once."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                     F.col(vector_col).cast("array<double>").alias("vec")).filter(
        "id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")

    def usable(batch: pa.RecordBatch) -> dict[str, object]:
        ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = []
        for id_, label, vec in zip(ids, labels, batch.column(2)):
            v = vec.values
            if v.null_count:
                continue
            x = v.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                x = np.floor(x * scale)
            if np.isfinite(x).all():
                found.append((id_, label, (x + 0.0).tobytes(), group_of(label, len(x))))
        return {k: [f[i] for f in found] for i, k in enumerate(("id", "label", "vec", "grp"))}

    return map_batches(rows, usable, "id long, label string, vec binary, grp int").distinct()


def group_of(label: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{size} {label}".encode()) % GROUPS


def points_of(rows: DataFrame, keep: int) -> DataFrame:
    """``(label, vec, grp, ids)``: a row per distinct label and vector with its ``keep`` smallest ids."""
    first = Window.partitionBy("label", "vec").orderBy("id")
    return (rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= keep)
            .groupBy("label", "vec").agg(F.first("grp").alias("grp"), F.sort_array(F.collect_list("id")).alias("ids")))


def augmented(squares: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, most - squares))


def spread_centres(x: np.ndarray, extra: np.ndarray, wanted: int) -> np.ndarray:
    """Places of ``wanted`` centres, each the farthest point from those before."""
    chosen, gap = [0], None
    while len(chosen) <= wanted:
        c = chosen[-1]
        d = ((x - x[c]) ** 2).sum(axis=1) + (extra - extra[c]) ** 2
        gap = d if gap is None else np.minimum(gap, d)
        far = int(gap.argmax())
        if gap[far] <= 0 or len(chosen) == wanted:
            break
        chosen.append(far)
    return np.array(chosen)


class TopLevel:
    """Centres of the commonest vector length of the sample; other lengths have one cell without a bound."""

    def __init__(self, centres: np.ndarray, most: float) -> None:
        self.centres, self.most = centres, most
        self.squares = (centres ** 2).sum(axis=1)
        self.extra = augmented(self.squares, most)

    def knows(self, x: np.ndarray) -> bool:
        return len(self.centres) > 0 and len(x) == self.centres.shape[1]

    def place(self, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cells of points and their distances from the cells' centres; cell -1 without a centre."""
        cell, gap = np.full(len(points), -1), np.full(len(points), np.inf)
        at = np.array([k for k, x in enumerate(points) if self.knows(x)], dtype=np.int64)
        if len(at):
            x = np.array([points[k] for k in at])
            squares = (x ** 2).sum(axis=1)
            extra = augmented(squares, self.most)
            d = squares[:, None] + self.squares - 2 * x @ self.centres.T + (extra[:, None] - self.extra) ** 2
            c = d.argmin(axis=1)
            cell[at] = c
            gap[at] = np.sqrt(((x - self.centres[c]) ** 2).sum(axis=1) + (extra - self.extra[c]) ** 2)
        return cell, gap


def bounds(products: np.ndarray, square: float, most: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product in balls, from those of their centres; a little wider than exact.

    Augmented vectors lie on a sphere: a ball is a cap, and the angle to the query does the rest.
    """
    length = np.sqrt(square) * np.sqrt(most)
    if length <= 0:
        return np.full(len(products), -1e-6), np.full(len(products), 1e-6)
    angle = np.arccos(np.clip(products / length, -1.0, 1.0))
    width = 2 * np.arcsin(np.minimum(1.0, radius / (2 * np.sqrt(most))))
    slack = 1e-6 * length + 1e-6
    return (length * np.cos(np.minimum(np.pi, angle + width)) - slack,
            length * np.cos(np.maximum(0.0, angle - width)) + slack)


class Found:
    """The best ``k`` (score, id) of every window of a query."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.need = low.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in low]

    def wants(self, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Whether balls of these bounds can still hold a result of any window."""
        out = np.zeros(len(lower), dtype=bool)
        for need, high in zip(self.need, self.high):
            out |= (upper >= need) & (lower <= high) & (need <= high)
        return out

    def offer(self, scores: np.ndarray, ids: list[list[int]], own: int) -> None:
        for w, high in enumerate(self.high):
            at = np.flatnonzero((scores >= self.need[w]) & (scores <= high))
            if len(at) > self.k:
                at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
            if not len(at):
                continue
            more = [(-int(scores[j]), i) for j in at for i in ids[j] if i != own]
            self.best[w] = heapq.nsmallest(self.k, itertools.chain(self.best[w], more))
            if len(self.best[w]) == self.k:
                self.need[w] = max(self.need[w], -self.best[w][-1][0])


class CoverTree:
    """Balls within balls over the points of one block, flattened: a ball's children and its points are ranges."""

    def __init__(self, x: np.ndarray, most: float) -> None:
        self.most = most
        extra = augmented((x ** 2).sum(axis=1), most)
        order, centre, radius = [], [], []
        self.points: list[tuple[int, int]] = []
        self.balls: list[tuple[int, int]] = []
        waiting = [(np.arange(len(x)), 0)]
        centre.append(0)
        radius.append(float(self._distance(x, extra, np.arange(len(x)), 0).max(initial=0.0)))
        at = 0
        while at < len(waiting):
            members, c = waiting[at]
            waiting[at] = None
            single, children = members, []
            if len(members) > LEAF and radius[at] > 0:
                parts = self._cover(x, extra, members, c, radius[at] / 2)
                single = np.concatenate([np.empty(0, np.int64)] + [m for _, m, r in parts if len(m) == 1 or r == 0])
                children = [p for p in parts if len(p[1]) > 1 and p[2] > 0]
            self.points.append((len(order), len(order) + len(single)))
            order.extend(single.tolist())
            self.balls.append((len(waiting), len(waiting) + len(children)))
            for child, m, r in children:
                waiting.append((m, child))
                centre.append(child)
                radius.append(r)
            at += 1
        self.order = np.array(order, dtype=np.int64)
        self.x, self.centres, self.radius = x[self.order], x[centre], np.array(radius)

    @staticmethod
    def _distance(x: np.ndarray, extra: np.ndarray, members: np.ndarray, c: int) -> np.ndarray:
        return np.sqrt(((x[members] - x[c]) ** 2).sum(axis=1) + (extra[members] - extra[c]) ** 2)

    def _cover(self, x: np.ndarray, extra: np.ndarray, members: np.ndarray, centre: int,
               scale: float) -> list[tuple[int, np.ndarray, float]]:
        """Centres more than ``scale`` apart with the members nearest to each, all within ``scale``."""
        gap = self._distance(x, extra, members, centre)
        owner, centres = np.zeros(len(members), dtype=np.int64), [centre]
        while gap[far := int(gap.argmax())] > scale:
            centres.append(int(members[far]))
            d = self._distance(x, extra, members, centres[-1])
            nearer = d < gap
            owner[nearer], gap[nearer] = len(centres) - 1, d[nearer]
            owner[far], gap[far] = len(centres) - 1, 0.0
        by = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by], np.arange(len(centres) + 1))
        return [(c, members[by[a:b]], float(gap[by[a:b]].max()))
                for c, a, b in zip(centres, cuts[:-1], cuts[1:]) if b > a]

    def search(self, q: np.ndarray, found: Found, ids: list[list[int]], fits: np.ndarray, own: int) -> None:
        """Offer ``found`` every point that fits and can matter; ``ids`` and ``fits`` are in the tree's order.

        Points that fit hold an id besides ``own``.
        """
        square = float(q @ q)
        lower, upper = bounds(self.centres[:1] @ q, square, self.most, self.radius[:1])
        queue = [(-upper[0], 0, lower[0])]
        while queue:
            up, ball, low = heapq.heappop(queue)
            if not found.wants(np.array([low]), np.array([-up]))[0]:
                continue
            a, b = self.points[ball]
            if b > a:
                at = a + np.flatnonzero(fits[a:b])
                scores = np.clip(self.x[at] @ q, -FAR, FAR).astype(np.int64)
                found.offer(scores, [ids[j] for j in at], own)
            a, b = self.balls[ball]
            if b > a:
                lower, upper = bounds(self.centres[a:b] @ q, square, self.most, self.radius[a:b])
                for j in np.flatnonzero(found.wants(lower, upper)):
                    heapq.heappush(queue, (-upper[j], a + int(j), lower[j]))


class Index:
    """Points in cells of the top level, as a written table, and the cells' radii and sizes."""

    def __init__(self, rows: DataFrame, keep: int) -> None:
        points = points_of(rows, keep)
        points = written(map_batches(points, _with_square, "label string, vec binary, grp int, ids array<long>, square double"),
                         "points")
        most = points.agg(F.max("square")).first()[0] or 0.0
        self.n = points.count()
        wanted = max(1, min(CENTRES, -(-self.n // BLOCK)))
        sample = points.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE)
        self.top = TopLevel(fit_in_task(sample, SAMPLE, lambda t: _centres(t, most, wanted)), most)
        self.points = written(map_batches(points, _Place(self.top), "label string, vec binary, grp int, ids array<long>, "
                                          "cell int, gap double"), "cells")
        # at most GROUPS * (CENTRES + 1) rows
        cells = written(self.points.groupBy("grp", "cell").agg(
            F.max("gap").alias("r"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "radii")
        self.cells = sorted((r["grp"], r["cell"], r["r"], r["parts"]) for r in cells.collect())
        first = F.shiftleft((F.col("grp") * (CENTRES + 1) + F.col("cell") + 1).cast("long"), 32)
        self.blocks = self.points.join(F.broadcast(cells.select("grp", "cell", "parts")), ["grp", "cell"]).select(
            (first + F.pmod(F.xxhash64("vec", "label"), "parts")).alias("block"), "label", "vec", "ids")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """``HIT`` rows: the best ``k`` of each window of ``queries`` (query, id, label, vec, low, high)."""
        near = self._hits(queries.withColumn("near", F.lit(True)), k, same)
        bound = (near.groupBy("query", "place").agg(F.min("score").alias("least"), F.count("*").alias("n"))
                 .filter(F.col("n") >= k).groupBy("query")
                 .agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("least")))
        raised = queries.join(bound, "query", "left").withColumn("low", F.transform(
            "low", lambda x, i: F.greatest(x, F.coalesce(F.col("least")[i.cast("int")], x)))).drop("least")
        rest = self._hits(raised.withColumn("near", F.lit(False)), k, same)
        return best(near.unionByName(rest), k)

    def _hits(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        slices = max(1, -(-queries.count() // SLICE))
        schema = "block long, query binary, id long, label string, vec binary, low array<long>, high array<long>"
        visits = written(map_arrow(queries, _Visits(self.top, self.cells, same), schema), "visits").withColumn(
            "slice", F.pmod(F.xxhash64("query"), F.lit(slices)))
        tasks = visits.select("block", "slice").distinct()
        one = self.blocks.join(tasks, "block").select("block", "slice", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("query"),
                                                 F.lit(None).cast("long").alias("id"), "label", "vec", "ids",
                                                 F.lit(None).cast("array<long>").alias("high"))
        two = visits.select("block", "slice", F.lit(1).alias("kind"), "query", "id", "label", "vec",
                            F.col("low").alias("ids"), "high")
        rows = one.unionByName(two).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind")
        return written(best(map_arrow(rows, _Search(self.top.most, k, same), HIT), k), "hits")


def _block(group: int, cell: int, part: int) -> int:
    return ((group * (CENTRES + 1) + cell + 1) << 32) + part


def best(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of every window: higher scores first, then smaller ids."""
    order = Window.partitionBy("query", "place").orderBy(F.desc("score"), "id")
    return hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def _with_square(batch: pa.RecordBatch) -> dict[str, object]:
    columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    x = [np.frombuffer(v) for v in columns["vec"].to_pylist()]
    with np.errstate(over="ignore"):
        return {n: columns[n] for n in ("label", "vec", "grp", "ids")} | {
            "square": [min(float(v @ v), np.finfo(np.float64).max) for v in x]}


def _centres(sample: pa.Table | None, most: float, wanted: int) -> np.ndarray:
    if sample is None:
        return np.empty((0, 0))
    found = [np.frombuffer(v) for v in sample.column("vec").to_pylist()]
    sizes, counts = np.unique([len(v) for v in found], return_counts=True)
    x = np.array([v for v in found if len(v) == sizes[counts.argmax()]])
    return x[spread_centres(x, augmented((x ** 2).sum(axis=1), most), wanted)]


class _Place:
    """The cell of every point of a batch."""

    def __init__(self, top: TopLevel) -> None:
        self.top = top

    def __call__(self, batch: pa.RecordBatch) -> dict[str, object]:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        cell, gap = self.top.place([np.frombuffer(v) for v in columns["vec"].to_pylist()])
        return {n: columns[n] for n in ("label", "vec", "grp", "ids")} | {"cell": cell, "gap": gap}


class _Visits:
    """The blocks that a query has to see: all parts of cells whose bounds meet one of its windows.

    Near rows go to the best such cell of each group, the others to the rest.
    """

    def __init__(self, top: TopLevel, cells: list[tuple], same: bool) -> None:
        self.top, self.same = top, same
        self.group, self.cell = (np.array([c[k] for c in cells], dtype=np.int64) for k in (0, 1))
        self.radius, self.parts = np.array([c[2] for c in cells]), np.array([c[3] for c in cells], dtype=np.int64)

    def _of(self, q: np.ndarray, label: str, low: list[int], high: list[int], near: bool) -> np.ndarray:
        at = np.flatnonzero(self.group == group_of(label, len(q))) if self.same else np.arange(len(self.group))
        lower, upper = np.full(len(at), -np.inf), np.full(len(at), np.inf)
        known = self.cell[at] >= 0
        if self.top.knows(q):
            lower[known], upper[known] = bounds(self.top.centres[self.cell[at[known]]] @ q, float(q @ q), self.top.most,
                                                self.radius[at[known]])
        known = known if not self.top.knows(q) else ~known
        upper[known], lower[known] = -np.inf, np.inf  # cells of other vector lengths
        first = np.zeros(len(at), dtype=bool)
        order = np.lexsort((-upper, self.group[at]))
        first[order[np.flatnonzero(np.diff(self.group[at][order], prepend=-1))]] = True
        wanted = np.zeros(len(at), dtype=bool)
        for a, b in zip(low, high):
            wanted |= (upper >= a) & (lower <= b) & (a <= b)
        return at[wanted & (first == near)]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("query", "id", "label", "vec", "low", "high")
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in (*names, "near")}
            for a in range(0, batch.num_rows, 256):
                rows, blocks = [], []
                for row in range(a, min(batch.num_rows, a + 256)):
                    q = np.frombuffer(columns["vec"][row].as_py())
                    low, high = columns["low"][row].as_py(), columns["high"][row].as_py()
                    for c in self._of(q, columns["label"][row].as_py(), low, high, columns["near"][row].as_py()):
                        n = int(self.parts[c])
                        rows += [row] * n
                        blocks += [_block(int(self.group[c]), int(self.cell[c]), p) for p in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64())] + [
                    columns[n].take(pa.array(rows, pa.int64())) for n in names], names=["block", *names])


class _Search:
    """Cover trees of a block's points, then the queries of its slice, one after another."""

    def __init__(self, most: float, k: int, same: bool) -> None:
        self.most, self.k, self.same = most, k, same

    def _trees(self, points: list[tuple]) -> dict[int, tuple]:
        sizes: dict[int, list] = {}
        for label, vec, ids in points:
            sizes.setdefault(len(vec), []).append((label, vec, ids))
        trees = {}
        for size, members in sizes.items():
            tree = CoverTree(np.array([np.frombuffer(m[1]) for m in members]).reshape(len(members), -1), self.most)
            labels = np.array([members[j][0] for j in tree.order], dtype=object)
            ids = [members[j][2] for j in tree.order]
            only = np.array([i[0] if len(i) == 1 else None for i in ids], dtype=object)
            trees[size] = (tree, ids, labels, only)
        return trees

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, points, trees, fits = None, [], None, {}
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist()
                       for n in ("block", "slice", "kind", "query", "id", "label", "vec", "ids", "high")]
            out: list[tuple] = []
            for block, part, kind, query, own, label, vec, ids, high in zip(*columns):
                if key != (block, part):
                    key, points, trees, fits = (block, part), [], None, {}
                if kind == 0:
                    points.append((label, vec, ids))
                    continue
                if trees is None:
                    trees, points = self._trees(points), []
                if len(vec) not in trees:
                    continue
                tree, point_ids, labels, only = trees[len(vec)]
                if (len(vec), label) not in fits:
                    fits[len(vec), label] = (labels == label) if self.same else (labels != label)
                found = Found(np.array(ids), np.array(high), self.k)
                tree.search(np.frombuffer(vec), found, point_ids, fits[len(vec), label] & (only != own), own)
                out += [(query, w, -s, i) for w, hits in enumerate(found.best) for s, i in hits]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int64(), pa.int64()))],
                names=["query", "place", "score", "id"])


def hard_negatives(df: DataFrame, anchors: Column | str, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 5,
                   low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    For every anchor (rows for which ``anchors``, a condition on ``id``, holds):
    its first ``positives`` other rows of the same label, and for each of these
    the first ``negatives`` rows of other labels whose score lies between the two
    shares of the positive's score.
    """
    rows = written(vectors(df, id_col, vector_col, label_col, scale), "vectors")
    index = Index(rows, max(positives, negatives) + 1)
    condition = F.expr(anchors) if isinstance(anchors, str) else anchors
    queries = written(rows.filter(condition).select(
        F.substring(F.unhex(F.sha2(F.concat(F.encode(F.concat_ws(" ", "id", "label"), "UTF-8"), "vec"), 256)), 1, 16).alias("query"), "id", "label",
        "vec"), "anchors")
    whole = F.array(F.lit(-FAR)), F.array(F.lit(FAR))
    near = index.search(queries.withColumns({"low": whole[0], "high": whole[1]}), positives, same=True)
    ranked = written(near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")))
                                               .alias("found")), "positives")
    exact = "decimal(20,0)"  # shares of a score are whole numbers, rounded inwards
    low = F.transform("found", lambda p: -F.floor(p["minus"].cast(exact) * low_percent / 100).cast("long"))
    high = F.transform("found", lambda p: -F.ceil(p["minus"].cast(exact) * high_percent / 100).cast("long"))
    windows = written(queries.join(ranked, "query").select("query", "id", "label", "vec", low.alias("low"),
                                                           high.alias("high")), "negative-windows")
    hits = index.search(windows, negatives, same=False)
    order = Window.partitionBy("query", "place").orderBy(F.desc("score"), "id")
    pairs = ranked.select("query", F.posexplode("found").alias("place", "positive"))
    return (hits.withColumn("rank", F.row_number().over(order)).join(pairs, ["query", "place"])
            .join(queries.select("query", F.col("id").alias("anchor_id")), "query")
            .select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                    (-F.col("positive.minus")).alias("positive_score"), F.col("score").alias("negative_score")))
