"""Substring dedup against brute force: shared passages, copies, runs of one word, edge rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from shopmetrics.llm import substrings as sub
from tests.llm.data import DOCUMENTS, edge_rows, with_clashes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, window=sub.WINDOW):
    texts = [WORD.findall(t or "") for _, t in rows]
    often = Counter(tuple(w[k: k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = set()
        for k in range(len(w) - window + 1):
            if often[tuple(w[k: k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(12)
    passages = [words(rng, n) for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(120):
        parts = words(rng, rng.randrange(0, 90), 200)
        for _ in range(rng.randrange(0, 3)):
            parts += rng.choice(passages) + words(rng, rng.randrange(0, 40), 200)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    base = words(rng, 300)
    for i in range(60):  # one family of near copies, and copies
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(300)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, rows[3][1]), (301, rows[3][1].upper()), (302, "a " * 400), (303, "a b " * 30 + "c"),
             (304, " ".join(passages[4] + passages[4])), (305, "x y z " * 50)]
    return rows


def test_removal_equals_brute_force(spark):
    rows = corpus()
    df = with_clashes(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert sorted((tuple(r) for r in sub.remove_repeats(df).collect()), key=str) == by_hand(rows)
    short = sub.remove_repeats(df, with_text=False)
    assert sorted((tuple(r) for r in short.collect()), key=str) == [r[:4] for r in by_hand(rows)]


def test_edge_rows(spark):
    rows = edge_rows()
    df = with_clashes(spark.createDataFrame(rows, DOCUMENTS))
    assert sorted((tuple(r) for r in sub.remove_repeats(df).collect()), key=str) == by_hand([r[:2] for r in rows])
    assert sub.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_are_split_piece_by_piece(monkeypatch):
    text = " ".join(words(random.Random(1), 3000)).encode() + b"\t" * 700 + b"end" * 300
    want = sub.word_hashes(text)
    monkeypatch.setattr(sub, "CHUNK", 100)
    assert (sub.word_hashes(text) == want).all() and len(want) == 3001


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    shared = words(rng, 80, 30)
    texts = [words(rng, a, 30) + shared + words(rng, b, 30) for a, b in ((0, 7), (40, 0), (99, 50))]
    seen = []
    for at, w in zip((0, 40, 99), texts):
        runs = sub.Runs(sub.word_hashes(" ".join(w).encode()))
        first, last, seed, _ = sub.anchors(runs)
        assert first[0] == 0 and last[-1] == runs.n - sub.WINDOW and (first[1:] == last[:-1] + 1).all()
        seen.append([int(seed[np.searchsorted(last, p)]) for p in range(at, at + 80 - sub.WINDOW + 1)])
    assert seen[0] == seen[1] == seen[2]


def test_runs_tell_positions_apart():
    runs = sub.Runs(sub.word_hashes(b"a b a b b a"))
    two = runs.all(2)
    assert two[0] == two[2] and two[1] == two[4] and len({int(x) for x in two}) == 3
    assert runs.of(np.array([0]), np.array([2]))[0] == two[0]


def test_least_places():
    rng = np.random.default_rng(9)
    for width in (1, 2, 3, 7, 8, 26):
        x = rng.integers(0, 9, 300).astype(np.uint64) << np.uint64(40)  # many ties
        want = [k + int(x[k: k + width].argmin()) for k in range(len(x) - width + 1)]
        assert sub.least_places(x, width).tolist() == want
