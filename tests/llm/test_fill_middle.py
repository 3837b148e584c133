"""Fill-in-middle: ranks and cuts against plain Python, forms, exact restoring, edge rows."""

import hashlib
import random

import numpy as np
import pytest

from shopmetrics.llm import fill_middle as fm
from tests.llm.data import DOCUMENTS, edge_rows, with_clashes


def by_hand(doc_id, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_ranks_and_places_equal_counting():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fm.WaveletMatrix(symbols)
        at = np.arange(n + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [int((symbols[:k] == s).sum()) for k in at]
        for unit in (1, 2, 4):
            has = (symbols & unit) > 0
            starts = [int(has[:k].sum()) for k in at]
            assert matrix.starts(unit, at).tolist() == starts
            count = np.arange(starts[-1] + 1)
            want = [max(k for k in at if starts[k] <= c) for c in count]
            got = matrix.find(unit, count, np.zeros(len(count), np.int64), np.full(len(count), n))
            assert got.tolist() == want


def test_words_and_lines_are_cut_where_they_start():
    texts = ["ein  zwölf\n\ndrei 漢字", "", " x", "\n", "a\tb\nc"]
    data = [t.encode() for t in texts]
    for unit, n in (("word", [4, 0, 1, 0, 3]), ("line", [3, 0, 1, 1, 2])):
        draws = [np.arange(5), np.arange(5) + 2]
        got = fm.cut_places(data, draws, unit)
        assert got["n"].tolist() == n
        for text, one, two, c1, c2 in zip(data, got["one"], got["two"], got["one_chars"], got["two_chars"]):
            assert len(text[:one].decode()) == c1 and len(text[:two].decode()) == c2
    first = fm.cut_places([b"ab cd ef"], [np.array([1]), np.array([2])], "word")
    assert (first["one"][0], first["two"][0]) == (3, 6)


def corpus():
    rng = random.Random(6)
    letters = "ab \n<P>SM漢é😀.\t"
    return [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))) for i in range(600)]


@pytest.mark.parametrize("span", [fm.SPAN, 50])
def test_outputs_equal_plain_python(spark, span):
    rows = [r[:2] for r in edge_rows()] + corpus()
    texts = [(t or "").encode() for _, t in rows]
    for a, b in fm._spans([len(t) for t in texts]):
        assert b == a + 1 or sum(len(t) for t in texts[a:b]) <= fm.SPAN
    df = with_clashes(spark.createDataFrame([(*r, None, None, None) for r in rows], DOCUMENTS))
    made = fm.fill_in_middle(df)
    got = sorted(made.withColumn("text", fm.restored()).collect(), key=str)
    want = sorted(((i, *by_hand(i, t)) for i, t in rows), key=str)
    assert sorted([tuple(r)[:6] for r in got], key=str) == want
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_one_matrix_spans_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(fm, "SPAN", 10)
    assert list(fm._spans([4, 6, 1, 20, 3, 0, 7])) == [(0, 2), (2, 3), (3, 4), (4, 7)]
    assert list(fm._spans([])) == []


def test_seed_and_shares_are_parameters(spark):
    df = spark.createDataFrame(corpus(), "doc_id BIGINT, text STRING")
    forms = {r["form"] for r in fm.fill_in_middle(df, plain_percent=0, spm_percent=100).filter("n > 0").collect()}
    assert forms <= {"spm", "plain"}
    one, two = (fm.fill_in_middle(df, seed=s).collect() for s in (1, 2))
    assert one != two
    assert fm.fill_in_middle(df.limit(0)).count() == 0
