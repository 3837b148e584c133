"""N-gram Jaccard join and embedding links against brute force; blocks, components, skew."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopmetrics.llm import embedding_links as el
from shopmetrics.llm import linking
from shopmetrics.llm import ngram_join as nj
from tests.llm.data import DOCUMENTS, edge_rows, with_clashes, words


def classes_of(links, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_texts(rows, similarity=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]
             and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    degree = {i: 0 for i in sets}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, classes_of(links, sets)


def corpus():
    """Exact copies, a family of many near copies around the threshold, shared passages, short texts."""
    rng = random.Random(8)
    rows, i = [], 0
    shared = words(rng, 40)
    for _ in range(150):
        rows.append((i, " ".join(words(rng, rng.randrange(30, 200)) + (shared if rng.random() < 0.5 else []))))
        i += 1
    base = words(rng, 250)
    for _ in range(260):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
        i += 1
    for k in range(40):
        rows.append((i, rows[k % 7][1] if k % 2 else rows[k % 7][1].upper() + "  "))
        i += 1
    rows += [(i, "one two"), (i + 1, "one  two"), (i + 2, "one two three"), (i + 3, ""), (i + 4, ""), (i + 5, None)]
    return rows


def test_jaccard_join_equals_brute_force(spark):
    rows = corpus()
    df = with_clashes(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    degree, label = brute_texts(rows)
    got = nj.ngram_jaccard_join(df).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == degree
    assert {r["doc_id"]: r["class_id"] for r in got} == label
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_jaccard_join_splits_buckets_and_blocks(spark, monkeypatch):
    # tiny limits: buckets are split over several levels, clusters over several blocks
    monkeypatch.setattr(nj, "SMALL", 5)
    monkeypatch.setattr(linking, "BLOCK", 50)
    monkeypatch.setattr(linking.in_blocks, "__defaults__", (50,))
    monkeypatch.setattr(linking.link_clusters, "__defaults__", (50,))
    rows = corpus()
    degree, label = brute_texts(rows)
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in got} == {i: (degree[i], label[i]) for i in degree}


def test_jaccard_join_edge_rows(spark):
    df = with_clashes(spark.createDataFrame(edge_rows(), DOCUMENTS))
    got = nj.ngram_jaccard_join(df).collect()
    assert len(got) == len(edge_rows())
    by_id = {r["doc_id"]: (r["n_links"], r["class_id"], r["kept"]) for r in got}
    assert by_id[None] == (0, None, True) and by_id[1] == (0, 1, True) and by_id[5] == (1, 5, True)
    assert nj.ngram_jaccard_join(df.limit(0)).count() == 0
    assert nj.ngram_jaccard_join(df.where("text IS NULL")).count() == 1


def test_members_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 0)
    rows = corpus()[:200]
    degree, _ = brute_texts(rows)
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == degree


def test_runs_reach_the_recall():
    assert nj.missed(0.8) ** nj.runs_for(0.8, 0.999) <= 0.001
    rng = np.random.default_rng(1)
    met = 0
    trials = 400
    for _ in range(trials):   # pairs of embeddings that share 80 in 100 tokens
        a = rng.integers(0, 2 ** 32, nj.WIDTH, dtype=np.uint32)
        b = np.where(rng.random(nj.WIDTH) < 0.8, a, a ^ np.uint32(1))
        paths = [(nj.mix(np.array([rng.integers(1, 2 ** 63)], dtype=np.uint64))[0],)]
        alive = [paths[0][0]]
        for _ in range(4):
            nxt = []
            for p in alive:
                x = nj.children(np.array([p] * 2, dtype=np.uint64), np.stack([a, b]))
                one, two = (set(x[1][x[0] == k].tolist()) for k in (0, 1))
                nxt += [np.uint64(v) for v in one & two]
            alive = nxt[:40]
        met += bool(alive)
    assert abs((1 - met / trials) - nj.missed(0.8, 4)) < 0.08


def test_jaccard_counts():
    a, b, c = (np.array(x, dtype=np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [9]))
    linked = nj.jaccard_links([a, b, c], 0.8)
    assert linked[0, 1] and linked[1, 0] and not linked[0, 2] and not linked[2, 1]


# -- components ------------------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 300)] \
        + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)]
    df = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in edges],
                               "node binary, root binary")
    got = {int.from_bytes(bytes(r["node"])): int.from_bytes(bytes(r["label"])) for r in
           linking.components(df, "t").collect()}
    want = classes_of(edges, sorted({x for e in edges for x in e}))
    assert got == {k: v for k, v in want.items() if (k in got)}
    assert set(want) - set(got) <= {a for a, b in edges if a == b}
    assert linking.components(df.limit(0), "t").count() == 0


def test_roots():
    linked = np.zeros((6, 6), dtype=bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert linking.roots(linked).tolist() == [0, 1, 1, 0, 4, 0]


# -- embeddings ------------------------------------------------------------------------------
def brute_vectors(rows, cosine=0.95):
    ok = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, dtype=np.float64)
            ok[i] = x / np.linalg.norm(x)
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine]
    degree = {i: 0 for i, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, classes_of(links, [i for i, _ in rows])


def vector_rows():
    rng = np.random.default_rng(6)
    rows = [rng.standard_normal(32) for _ in range(300)]
    for c in range(4):
        centre = rng.standard_normal(32)
        rows += [centre + 0.2 * rng.standard_normal(32) for _ in range(30 + 60 * c)]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], rows[5]]
    rows += [None, [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [], [1.0, 2.0],
             [1.0, 2.0], [1e-30] + [0.0] * 31]
    return list(enumerate(rows))


def test_embedding_links_equal_brute_force(spark):
    rows = vector_rows()
    df = with_clashes(spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>").withColumn("label", F.lit(3)))
    degree, label = brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v])
                                   for i, v in rows])
    got = el.embedding_links(df).collect()
    assert len(got) == len(rows)
    found, want = sum(r["n_links"] for r in got), sum(degree.values())
    assert found <= want and found >= 0.995 * want
    assert {r["vec_id"]: r["class_id"] for r in got} == label
    empty = el.embedding_links(df.limit(0))
    assert empty.count() == 0
    no_id = el.embedding_links(spark.sql("SELECT CAST(NULL AS BIGINT) AS vec_id, array(1.0F) AS embedding")).first()
    assert (no_id["n_links"], no_id["class_id"]) == (0, None)


def test_embedding_calibration():
    # a pair at the threshold reaches the count and meets in a bucket as often as promised
    rng = np.random.default_rng(3)
    need, counts = el.least_collisions(0.95, 0.999), []
    for _ in range(300):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        counts.append(el.collisions(np.stack([a, 0.95 * a + np.sqrt(1 - 0.95 ** 2) * b]), 0.95)[0, 1])
    assert np.mean(np.array(counts) >= need) > 0.98
    for keys in (1, 3, 6):
        assert 1 - (1 - el.same_range(0.95) ** keys) ** el.groups_for(0.95, 0.999, keys) >= 0.999
    assert el.keys_for(10 ** 9, 16) > el.keys_for(10 ** 4, 16)


@pytest.mark.parametrize("cosine", [0.8, 0.99])
def test_other_thresholds(spark, cosine):
    rows = vector_rows()[:500]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    degree, _ = brute_vectors([(i, [float(np.float32(x)) for x in v]) for i, v in rows], cosine)
    got = {r["vec_id"]: r["n_links"] for r in el.embedding_links(df, cosine=cosine).collect()}
    assert sum(got.values()) >= 0.99 * sum(degree.values())
    assert all(got[i] <= degree[i] for i in degree)
