"""Operator 9: quality rules.

Base rules on counts of each whole text, then a logistic regression on hashed
word and character n-grams, trained on labelled rows, turned into a probability
by a logistic curve through held-back rows, and scored in Arrow batches against
a fixed threshold.

Words are runs of characters other than the six ASCII spaces. A text fails the
base rules with fewer than ``MIN_WORDS`` words, or if words in repeated 3-word
windows are over half of all. The rest is kept if the model gives it at least
``KEEP_FROM`` probability of quality 1. Without labelled rows of both kinds
there is no model, and the base rules alone decide.

A null text has no words and fails. Ties and repeated rows get equal results.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrays, filter_rows, fit_in_task, map_batches, texts
from .folds import labelled_sample
from .linear import FtrlSoftmax, code_points, ngram_counts, platt, sparse, unit

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
WORD_BITS, CHAR_BITS = 15, 15
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers for the words of one text, equal for equal words, and the words by number."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    return ids, list(seen)


def repeated_window_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 21:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pair = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * distinct + ids[2:]
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[which] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        inside[k: k + len(twice)] |= twice
    return int(inside.sum())


def text_stats(raw: bytes, words: list[bytes], ids: np.ndarray, distinct: int) -> tuple[int, ...]:
    """The counts of ``STATS`` for one text in UTF-8."""
    joined = np.frombuffer(b"".join(words), dtype=np.uint8)
    seen: set[bytes] = set()
    repeats = 0
    for line in raw.split(b"\n"):
        if line.strip():
            if line in seen:
                repeats += 1
            else:
                seen.add(line)
    return (len(words), int(((joined & 0xC0) != 0x80).sum()), len(raw) - len(raw.translate(None, SYMBOLS)),
            repeats, repeated_window_words(ids, distinct))


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def features(text: str, ids: np.ndarray, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word 1- and 2-grams and character 2- to 4-grams, each kind with unit length."""
    hashes = np.fromiter(map(zlib.crc32, distinct), dtype=np.uint32, count=len(distinct))
    w_at, w = sparse(ngram_counts(hashes[ids], (1, 2), WORD_BITS))
    c_at, c = sparse(ngram_counts(code_points(text), (2, 3, 4), CHAR_BITS))
    return np.concatenate([w_at, c_at + (1 << WORD_BITS)]), np.concatenate([unit(w), unit(c)])


@dataclass
class QualityModel:
    weights: np.ndarray  # log-odds by feature
    bias: float
    slope: float
    offset: float

    def probability(self, at: np.ndarray, x: np.ndarray) -> float:
        s = self.slope * (float(x @ self.weights[at]) + self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(s, -40, 40))))


def fit(sample: pa.Table | None, epochs: int = 3) -> QualityModel | None:
    """A model from rows ``(label, at, x)``; None without rows of both kinds."""
    if sample is None:
        return None
    data = sorted(zip(arrays(sample.column("at"), "i4"), arrays(sample.column("x"), "f4"),
                      sample.column("label").to_pylist()),
                  key=lambda d: (d[2], len(d[0]), d[0].tobytes(), d[1].tobytes()))
    kinds = np.array([d[2] for d in data])
    if len(set(kinds.tolist())) < 2:
        return None
    order = np.random.default_rng(11).permutation(len(data))
    held, learned = order[: len(data) // 5], order[len(data) // 5:]
    if len(set(kinds[learned].tolist())) < 2:
        held, learned = order[:0], order
    model = FtrlSoftmax((1 << WORD_BITS) + (1 << CHAR_BITS), 2)
    for _ in range(epochs):
        for k in learned:
            model.learn(*data[k])
    w = model.weights()
    weights, bias = w[:, 1] - w[:, 0], float(model.bias[1] - model.bias[0])
    slope, offset = platt(np.array([data[k][1] @ weights[data[k][0]] + bias for k in held]), kinds[held])
    return QualityModel(weights.astype(np.float32), bias, slope, offset)


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 2000) -> QualityModel | None:
    """Fit on at most ``max_rows`` labelled texts of each kind.

    ``documents(doc_id, text)``, ``labels(doc_id, quality)``. Rows that fail
    the base rules are not learned from: the model never sees their like.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"label": [], "at": [], "x": []}
        for label, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            words = text.encode("utf-8", "replace").split()
            ids, distinct = word_ids(words)
            if not fails_base(len(words), repeated_window_words(ids, len(distinct))):
                at, x = features(text, ids, distinct)
                out["label"].append(label)
                out["at"].append(at)
                out["x"].append(x)
        return out

    sample = labelled_sample(documents, labels, "quality", {0: max_rows, 1: max_rows})
    found = map_batches(sample, run, "label int, at array<int>, x array<float>")
    return fit_in_task(found, 2 * max_rows, fit)


def judge(text: str, model: QualityModel | None, keep_from: float = KEEP_FROM) -> tuple:
    """Stats, base verdict, probability (None without a model or where the base rules fail), verdict."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at exactly the six ASCII spaces
    ids, distinct = word_ids(words)
    stats = text_stats(raw, words, ids, len(distinct))
    if fails_base(stats[0], stats[4]):
        return (*stats, True, None, False)
    p = None if model is None else model.probability(*features(text, ids, distinct))
    return (*stats, False, p, p is None or p >= keep_from)


def assess(rows: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text",
           keep_from: float = KEEP_FROM) -> DataFrame:
    """Per row: the counts, ``base_failed``, the probability of quality 1, and ``kept``."""
    names = (*STATS, "base_failed", "probability", "kept")

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = list(zip(*(judge(t, model, keep_from) for t in texts(batch.column(1)))))
        return {id_col: batch.column(0), **dict(zip(names, found))}

    kind = rows.schema[id_col].dataType.simpleString()
    stats = ", ".join(f"{s} long" for s in STATS)
    return map_batches(rows.select(id_col, text_col), run,
                       f"`{id_col}` {kind}, {stats}, base_failed boolean, probability double, kept boolean")


def keep(rows: DataFrame, model: QualityModel | None, text_col: str = "text", keep_from: float = KEEP_FROM,
         ) -> DataFrame:
    """The rows that pass the base rules and the model, with all their columns."""
    return filter_rows(rows, text_col, lambda text: judge(text, model, keep_from)[-1])
