"""Operator 1: n-gram Jaccard self-join by chosen paths.

A text is the set of its word 5-grams (lower-cased words between white space; a
shorter text is one n-gram). Texts with equal sets are one node. Each set is
embedded into ``WIDTH`` min-hash tokens, two sets sharing about the part of
them that is their Jaccard similarity. A run starts with all nodes in one
bucket and splits buckets recursively: at a bucket, coordinates are sampled by
a hash of its path, and every node goes on to the bucket of its token there.
Small buckets are compared by brute force, as are buckets that a split hardly
shrinks (copies of one another) and those at the depth limit; larger ones are
split again. ``runs_for`` gives the number of runs at which a pair at the
threshold meets with the target probability.

Comparing in a bucket means counting equal tokens; pairs that may be similar
become star edges, their components clusters, and all pairs of a cluster are
verified on their whole n-gram sets (``linking``). Result: per document
``n_links`` (other documents with similarity at or over the threshold, copies
included) and ``class_id`` (smallest id reachable by links).

A null or empty text has no n-grams and links with nothing; a row without id
is not compared (class null, no links). Rows that repeat id and text are
copies. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches, texts, written
from .linking import STAR, classes, in_blocks, link_clusters, map_groups, star_rows, task_pairs

N = 5
THRESHOLD = 0.8
WIDTH = 64
CHILDREN = 2.0  # sampled coordinates of a bucket, on average
DEPTH = 8
RECALL = 0.999
SMALL = 100
SHRINKS_TO = 0.7
BROADCAST_ROWS = 200_000  # members joined map-side, about 8 MB; more are joined by shuffle
KEPT_WORDS = 150_000

_SEEDS = np.random.default_rng(2024).integers(1, 2 ** 63, size=WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_SEEDS = np.random.default_rng(77).integers(1, 2 ** 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_kept: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    found = [_kept.get(w) for w in words]
    if None in found:
        if len(_kept) > KEPT_WORDS:
            _kept.clear()
        for k, f in enumerate(found):
            if f is None:
                found[k] = _kept[words[k]] = xxhash.xxh3_64_intdigest(words[k].encode("utf-8", "replace"))
    ids = np.array(found, dtype=np.uint64)
    width = min(n, len(ids))
    h = np.full(len(ids) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = mix(h * _WORD_SEEDS[k % len(_WORD_SEEDS)] + ids[k: k + len(h)])
    return np.unique(h)


def tokens(found: np.ndarray) -> np.ndarray:
    """The min-hash embedding of a set: one 32-bit token per coordinate."""
    low = np.full(WIDTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 1024):
        h = found[None, at: at + 1024] * _SEEDS[:, None]
        h ^= h >> np.uint64(29)
        np.minimum(low, (h * np.uint64(0x9E3779B97F4A7C15)).min(axis=1), out=low)
    return (mix(low) & np.uint64(0xFFFFFFFF)).astype("<u4")


def missed(similarity: float, depth: int = DEPTH) -> float:
    """Probability that a pair is separated in one run that goes down to ``depth``."""
    q = 0.0
    for _ in range(depth):
        q = (1 - CHILDREN / WIDTH * similarity * (1 - q)) ** WIDTH
    return q


def runs_for(similarity: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed(similarity))))


def least_equal(similarity: float) -> int:
    """Equal tokens below which a pair is not looked at: four deviations under the mean."""
    p = similarity + (1 - similarity) / 256
    return max(1, math.floor(WIDTH * p - 4 * math.sqrt(WIDTH * p * (1 - p))))


def sampled(paths: np.ndarray) -> np.ndarray:
    """Which coordinates the buckets with these paths split by (one row per path)."""
    h = mix(paths[:, None] + np.arange(1, WIDTH + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(32)) < np.uint64(int(CHILDREN / WIDTH * 2 ** 32))


def children(paths: np.ndarray, embedded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and paths of the buckets that rows go on to."""
    row, at = np.nonzero(sampled(paths))
    token = embedded[row, at].astype(np.uint64)
    return row, mix(mix(paths[row] ^ (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) + token)


def embed(documents: DataFrame, id_col: str, text_col: str, n: int = N) -> DataFrame:
    """``(id, node, tokens)`` of every row with an id; node and tokens are null for texts without n-grams."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        nodes, embedded = [], []
        for text in texts(batch.column(1)):
            found = shingles(text, n)
            nodes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            embedded.append(tokens(found).tobytes() if len(found) else None)
        return {id_col: batch.column(0), "node": nodes, "tokens": embedded}

    kind = documents.schema[id_col].dataType.simpleString()
    return map_batches(documents.select(id_col, text_col).filter(F.col(id_col).isNotNull()), run,
                       f"`{id_col}` {kind}, node binary, tokens binary")


def _as_rows(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, WIDTH)


def candidates(nodes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Star edges of all pairs that meet in a bucket and share enough tokens."""
    seeds = mix(np.arange(1, runs_for(similarity, recall) + 1, dtype=np.uint64))
    need = least_equal(similarity)

    def descend(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                embedded = _as_rows(part.column(1), "<u4")
                rows, paths = [], []
                for seed in (seeds if first else (None,)):
                    start = np.full(part.num_rows, seed, dtype=np.uint64) if first else \
                        part.column(2).to_numpy().view(np.uint64)
                    r, p = children(start, embedded)
                    rows.append(r)
                    paths.append(p)
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), pa.array(np.concatenate(paths).view(np.int64)),
                     part.column(3).take(row) if not first else
                     pa.array(np.full(len(row), np.iinfo(np.int64).max))], ["node", "path", "parent"])

    schema = "node binary, path long, parent long"
    level = map_arrow(nodes.select("node", "tokens"), lambda b: descend(b, True), schema)
    leaves: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        brute = F.lit(depth == DEPTH) | (F.col("size") <= SMALL) | (F.col("size") > SHRINKS_TO * F.col("parent"))
        met = written(level.join(sizes, "path").withColumn("leaf", brute), f"ngram-level{depth}")
        leaves.append(met.filter("leaf").select("path", "node", "size"))
        rest = met.filter("NOT leaf")
        if depth == DEPTH or rest.isEmpty():
            break
        split = rest.join(nodes.select("node", "tokens"), "node").select("node", "tokens", "path", "size")
        level = written(map_arrow(split, lambda b: descend(b, False), schema), f"ngram-split{depth}")
    met = leaves[0]
    for more in leaves[1:]:
        met = met.union(more)

    def shorten(batch: pa.RecordBatch) -> dict[str, object]:
        short = _as_rows(batch.column(1), "<u4").astype(np.uint8)
        return {"node": batch.column(0), "short": [s.tobytes() for s in short]}

    short = map_batches(nodes.select("node", "tokens"), shorten, "node binary, short binary")

    def compare(group: pa.Table) -> dict[str, object] | None:
        t = _as_rows(group.column("short"), "u1")
        equal = np.zeros((len(t), len(t)), dtype=np.uint8)
        for k in range(WIDTH):
            equal += t[:, k][:, None] == t[:, k][None, :]
        return star_rows(group, (equal >= need) & task_pairs(group))

    rows = met.join(short, "node").select("path", "node", "size", "short")
    return map_groups(in_blocks(rows, "path", "node", "size"), compare, STAR).filter("node != root")


def jaccard_links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets have at least the similarity; intersections by products of token incidence slices."""
    size = np.array([len(s) for s in sets], dtype=np.float64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size.astype(int))
    _, which, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[which] > 1
    column = (np.cumsum(count > 1) - 1)[which[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 4096
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, width):
        a, b = np.searchsorted(column, (at, at + width))
        incidence = np.zeros((len(sets), min(width, last - at)), dtype=np.float32)
        incidence[owner[a:b], column[a:b] - at] = 1
        common += incidence @ incidence.T
    union = size[:, None] + size[None, :] - common
    return common >= similarity * union - 1e-9


def ngram_jaccard_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       similarity: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """Per row: id, ``class_id``, ``n_links``, ``kept`` (the row's id is its class's)."""
    base = written(embed(documents, id_col, text_col, n), "ngram-base")
    nodes = written(base.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(id_col).alias("first_id"), F.count("*").alias("weight"), F.first("tokens").alias("tokens")),
        "ngram-nodes")
    stars = candidates(nodes, similarity, recall)

    def contents(members: DataFrame) -> DataFrame:
        """Whole n-gram sets of the members, read again from one text of each."""
        wanted = written(members.join(nodes.select("node", "first_id", "weight"), "node"), "ngram-members")
        ids = wanted.select(F.col("first_id").alias("_id")).distinct()
        ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
        source = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id")

        def run(batch: pa.RecordBatch) -> dict[str, object]:
            found = [shingles(t, n) for t in texts(batch.column(0))]
            return {"node": [xxhash.xxh3_128_digest(s.tobytes()) for s in found],
                    "found": [s.tobytes() for s in found]}

        sets = map_batches(source.select("_text"), run, "node binary, found binary") \
            .groupBy("node").agg(F.first("found").alias("found"))
        return wanted.join(sets, "node").select("node", "cluster", "_size", "weight", "found")

    def verify(group: pa.Table) -> np.ndarray:
        return jaccard_links([np.frombuffer(s, dtype="<u8") for s in group.column("found").to_pylist()], similarity)

    linked = link_clusters(stars, contents, verify, "ngram")
    ids = documents.select(id_col).filter(F.col(id_col).isNull())
    found = classes(base.select(id_col, "node"), nodes, linked, id_col)
    found = found.unionByName(ids.select(id_col, F.lit(0).cast("long").alias("n_links"),
                                         F.lit(None).cast(found.schema["class_id"].dataType).alias("class_id")))
    return found.select(id_col, "class_id", "n_links", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True))
                        .alias("kept"))
