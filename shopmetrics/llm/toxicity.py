"""Operator 5: toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text, one on toxic
text. Toxic rows consist mostly of ordinary words, so their toxic text is first
told apart: the stretches of their words covered by character n-grams that are
many times likelier in toxic rows.

A window is one word (a longer run of letters is cut into overlapping windows).
It is written ``REPEATS`` times, so that a frame is long enough to be coded
rather than stored; the repeats cost the same under either dictionary. The
length of the window, its length under the toxic dictionary and the difference
of the two compressed lengths make a cell. From labelled rows come the share of
ordinary windows in each cell and the number of extra windows a toxic row has
there. A text's evidence is the Poisson log-likelihood ratio of its cell counts
(so one borderline window counts less in a long text), and a logistic curve
through held-back rows turns it into the score. Scores are compared with a
fixed threshold.

Fitted on at most ``max_rows`` labelled rows of each kind, chosen by a hash of
the id. Without labelled rows of both kinds every score is 0. A null text is an
empty text and gets the score of no evidence. Texts are read whole. Repeated
rows get equal results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import filter_rows, fit_in_task, map_batches, texts
from .folds import labelled_sample
from .linear import platt

WORD = re.compile(r"\w+")
GRAMS = (4, 6, 8, 10, 12)
LIKELIER = 20  # how many times likelier in toxic rows a marked n-gram is
REPEATS = 8
LEVEL = 19
LONGEST = 32  # characters of a window
TOXIC_BYTES, ORDINARY_BYTES = 4096, 32768
THRESHOLD = 0.3
# cells: window bytes, bytes under the toxic dictionary, difference to the ordinary one, each clipped
CELLS = ((2, 16), (12, 27), (-7, 3))
N_CELLS = 15 * 16 * 11
KEPT_WINDOWS = 250_000  # per Python worker; emptied when full


def windows(text: str) -> set[str]:
    """The distinct windows of a text."""
    out: set[str] = set()
    for w in set(WORD.findall(text.lower())):
        if len(w) <= LONGEST:
            out.add(w)
        else:
            out.update(w[i: i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2))
    return out


def grams(word: str) -> set[str]:
    w = f" {word} "
    return {w[i: i + n] for n in GRAMS for i in range(len(w) - n + 1)}


def marked_parts(word: str, marked: set[str]) -> list[str]:
    """The stretches of a word covered by marked n-grams."""
    w = f" {word} "
    inside = [False] * len(w)
    for n in GRAMS:
        for i in range(len(w) - n + 1):
            if w[i: i + n] in marked:
                inside[i: i + n] = [True] * n
    parts = "".join(c if k else "\n" for c, k in zip(w, inside)).split("\n")
    return [p for p in parts if len(p) >= min(GRAMS)]


def without_near_copies(rows: list[list[str]]) -> list[list[str]]:
    """One of each group of near-equal window sets (at least 5 of 6 min-hashes shared with one
    taken before), so that words of a copied text do not pass for words of toxic text."""
    holders: dict[tuple[int, int], list[int]] = {}
    out: list[list[str]] = []
    for words in rows:
        raw = [w.encode("utf-8", "replace") for w in words]
        keys = [(k, min((zlib.crc32(w, 7919 * k) for w in raw), default=0)) for k in range(6)]
        shared = Counter(n for k in keys for n in holders.get(k, ()))
        if max(shared.values(), default=0) < 5:
            for k in keys:
                holders.setdefault(k, []).append(len(out))
            out.append(words)
    return out


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; samples too few to train on become its content as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    ratio: np.ndarray | None = None  # expected extra windows of a toxic text / share of ordinary windows
    extra: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    kept: dict[str, int] = field(default_factory=dict)
    compressors: tuple | None = None

    def __getstate__(self):
        return {**self.__dict__, "kept": {}, "compressors": None}

    def cell(self, window: str) -> int:
        """Number of the cell a window falls in."""
        known = self.kept.get(window)
        if known is None:
            if self.compressors is None:
                self.compressors = tuple(zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False,
                    write_checksum=False, write_dict_id=False) for d in (self.toxic, self.ordinary))
            raw = (f" {window}" * REPEATS + " ").encode("utf-8", "replace")
            toxic, ordinary = (len(c.compress(raw)) for c in self.compressors)
            known = 0
            for value, (low, high) in zip((len(raw) // REPEATS - 1, toxic, toxic - ordinary), CELLS):
                known = known * (high - low + 1) + min(max(value, low), high) - low
            if len(self.kept) >= KEPT_WINDOWS:
                self.kept.clear()
            self.kept[window] = known
        return known

    def cells(self, found) -> np.ndarray:
        return np.bincount(np.array([self.cell(w) for w in found], dtype=np.int64), minlength=N_CELLS)

    def evidence(self, counts: np.ndarray) -> float:
        n = int(counts.sum())
        at = np.flatnonzero(counts)
        return float((counts[at] * np.log1p(self.ratio[at] / max(n, 1))).sum()) - self.extra

    def score(self, text: str) -> float:
        s = self.slope * self.evidence(self.cells(windows(text))) + self.offset
        return float(1 / (1 + np.exp(-np.clip(s, -40, 40))))


def fit(sample: pa.Table | None) -> ToxicityModel | None:
    """A model from rows ``(label, words)``; None without rows of both kinds."""
    rows: dict[int, list[list[str]]] = {0: [], 1: []}
    if sample is not None:
        for label, words in sorted(zip(sample.column("label").to_pylist(), sample.column("words").to_pylist())):
            rows[label].append(words)
    if not rows[0] or not rows[1]:
        return None
    rng = np.random.default_rng(5)
    for kind in rows:
        rows[kind] = without_near_copies([rows[kind][i] for i in rng.permutation(len(rows[kind]))])
    fit = {k: v[len(v) // 4:] for k, v in rows.items()}
    held = {k: v[: len(v) // 4] or v for k, v in rows.items()}

    in_ordinary: Counter[str] = Counter()
    in_toxic: Counter[str] = Counter()
    for kind, counter in ((0, in_ordinary), (1, in_toxic)):
        for words in fit[kind]:
            counter.update(set().union(*map(grams, words)) if words else ())
    n0, n1 = len(fit[0]), len(fit[1])
    often = max(3, n1 // 60)
    marked = {g for g, k in in_toxic.items()
              if k >= often and k / n1 > LIKELIER * (in_ordinary[g] + 0.5) / n0}
    parts = [p for words in fit[1] for w in words for p in marked_parts(w, marked)]
    rng.shuffle(parts)
    plain = [" " + " ".join(words[i: i + 8]) + " " for words in fit[0] for i in range(0, len(words), 8)]
    rng.shuffle(plain)
    if not parts or not plain:
        return None
    model = ToxicityModel(
        dictionary(["".join(parts[i: i + 8]).encode() for i in range(0, len(parts), 8)], TOXIC_BYTES),
        dictionary([p.encode() for p in plain[:40_000]], ORDINARY_BYTES))

    # calibration on rows the dictionaries have not seen
    ordinary = [model.cells(w) for w in held[0]]
    toxic = [model.cells(w) for w in held[1]]
    total0 = np.sum(ordinary, axis=0).astype(float)
    size0, size1 = max(total0.sum(), 1.0), float(np.sum(toxic))
    share = (total0 + 0.2) / (size0 + 0.2 * len(total0))
    surplus = np.maximum(np.sum(toxic, axis=0) - 0.5 - size1 * share, 0.0)
    surplus[(np.sum(toxic, axis=0) < 3 * size1 * share)] = 0.0  # cells ordinary windows fill as well
    per_row = surplus / len(toxic)
    model.ratio, model.extra = per_row / share, float(per_row.sum())
    evidence = np.array([model.evidence(c) for c in ordinary + toxic])
    model.slope, model.offset = platt(evidence, np.array([0] * len(ordinary) + [1] * len(toxic)))
    return model


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 1500) -> ToxicityModel | None:
    """Fit on at most ``max_rows`` toxic and twice as many other labelled texts.

    ``documents(doc_id, text)``, ``labels(doc_id, toxic)``: all labels given may be learned from.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        return {"label": batch.column(0), "words": [sorted(windows(t)) for t in texts(batch.column(1))]}

    sample = labelled_sample(documents, labels, "toxic", {0: 2 * max_rows, 1: max_rows})
    return fit_in_task(map_batches(sample, run, "label int, words array<string>"), 3 * max_rows, fit)


def score_texts(rows: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text",
                threshold: float = THRESHOLD) -> DataFrame:
    """``(id, score, predicted)`` of every row, from its text alone."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        scores = [0.0 if model is None else model.score(t) for t in texts(batch.column(1))]
        return {id_col: batch.column(0), "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    kind = rows.schema[id_col].dataType.simpleString()
    return map_batches(rows.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, predicted int")


def keep(rows: DataFrame, model: ToxicityModel | None, text_col: str = "text", threshold: float = THRESHOLD,
         ) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    return filter_rows(rows, text_col, lambda text: model is None or model.score(text) < threshold)
