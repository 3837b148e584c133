"""Operator 4: language identification.

Sparse multinomial logistic regression on TF-IDF weighted character n-grams
(orders 1 to 3 of the lower-cased text, other characters as spaces, hashed),
trained by follow-the-regularised-leader with elastic-net penalties; softmax
probabilities are calibrated by a temperature found on held-back sample rows.

Document frequencies cover every learnable row. Every language that labels a
row with a letter is learned. The classifier is fitted on a bounded sample: at
most ``rows_per_language`` rows of each language, fewer where that makes more
than ``max_rows`` in all (but ``LEAST_ROWS``), chosen by a hash of the id.
Model and fit grow with the number of languages.

A null text, or one without a letter, is ``und`` with score 0. With no
learnable row (empty tables, only null labels) every row is ``und``. Texts are
read whole. A row without id is held out. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrays, fit_in_task, map_arrow, map_batches
from .linear import FtrlSoftmax, code_points, letter_table, ngram_counts, softmax, sparse, temperature, unit

BITS = 15
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
LEAST_ROWS = 5  # of a language, however many languages there are


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = letter_ngrams(text)
        if counts is None or not self.languages:
            return UNDETERMINED, 0.0
        at, tf = sparse(counts)
        x = unit(tf * self.idf[at])
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def letter_ngrams(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts, or None if there is no letter."""
    if not text:
        return None
    cp = code_points(text.lower())
    letters = letter_table()[cp]
    if not letters.any():
        return None
    return ngram_counts(np.where(letters, cp, np.uint32(32)), ORDERS, BITS)


def _document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows with a letter, and how many of them hold each feature.

    Every task sums its own rows; only one count per feature and task is shuffled.
    """
    size = 1 << BITS

    def run(batches):
        n, df = 0, np.zeros(size, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = letter_ngrams(text)
                if counts is not None:
                    n += 1
                    df += counts > 0
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, -1).astype("i4")), pa.array(np.append(df[at], n))], ["at", "df"])

    found = map_arrow(rows.select("text"), run, "at int, df long").groupBy("at").agg(F.sum("df").alias("df"))
    out, n = np.zeros(size), 0
    for r in found.collect():  # at most one row per feature
        if r["at"] < 0:
            n = r["df"]
        else:
            out[r["at"]] = r["df"]
    return n, out


def train(rows: DataFrame, rows_per_language: int = 600, max_rows: int = 38_400, epochs: int = 3,
          ) -> LanguageModel:
    """Learn from ``rows`` (doc_id, text, lang), all of which may be learned from."""
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    with_letter = rows.filter(F.col("text").rlike(r"\p{L}"))
    found = with_letter.groupBy("lang").agg(F.count("*").alias("_count"), F.min(draw).alias("_least")).collect()
    if not found:
        return LanguageModel([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    languages = sorted(r["lang"] for r in found)
    number = {name: k for k, name in enumerate(languages)}
    rows_per_language = min(rows_per_language, max(LEAST_ROWS, max_rows // len(languages)))
    n, df = _document_frequencies(rows)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0

    # a hash of the id thins each language to about twice the bound, a rank then holds the bound
    bounds = rows.sparkSession.createDataFrame(
        [(r["lang"], 2.0 * rows_per_language / r["_count"], r["_least"]) for r in found],
        "lang STRING, _keep DOUBLE, _least DOUBLE")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_draw"))
    sample = (with_letter.withColumn("_draw", draw).join(F.broadcast(bounds), "lang")
              .filter("_draw < _keep OR _draw = _least")
              .withColumn("_rank", rank).filter(F.col("_rank") <= rows_per_language))

    def features(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"lang": [], "draw": [], "at": [], "tf": []}
        for text, lang, draw in zip(*(batch.column(c).to_pylist() for c in range(3))):
            counts = letter_ngrams(text)
            if counts is not None:
                at, tf = sparse(counts)
                for k, v in zip(out, (lang, draw, at, tf)):
                    out[k].append(v)
        return out

    learnable = map_batches(sample.select("text", "lang", "_draw"), features,
                            "lang string, draw double, at array<int>, tf array<float>")

    def fit(table: pa.Table | None) -> LanguageModel:
        order = table.sort_by([("draw", "ascending"), ("lang", "ascending")]) if table is not None else None
        data = [] if order is None else [
            (at, unit(tf * idf[at]), number[lang]) for at, tf, lang in
            zip(arrays(order.column("at"), "i4"), arrays(order.column("tf"), "f4"), order.column("lang").to_pylist())]
        shuffled = np.random.default_rng(7).permutation(len(data))
        held, learned = shuffled[: len(data) // 5], shuffled[len(data) // 5:]
        known = {data[k][2] for k in learned}  # no language is only held back
        only_held = np.array([data[k][2] not in known for k in held], dtype=bool)
        held, learned = held[~only_held], np.concatenate([learned, held[only_held]])
        model = FtrlSoftmax(1 << BITS, len(languages))
        for _ in range(epochs):
            for k in learned:
                model.learn(*data[k])
        bias = model.bias
        weights = np.concatenate([model.weights(slice(i, i + 1024)).astype(np.float32) for i in range(0, 1 << BITS, 1024)])
        logits = np.array([data[k][1] @ model.weights(data[k][0]) + bias for k in held]).reshape(len(held), len(languages))
        return LanguageModel(languages, idf.astype(np.float32), weights, bias,
                             temperature(logits, np.array([data[k][2] for k in held], dtype=int)))

    return fit_in_task(learnable, rows_per_language * len(languages), fit)


def predict(rows: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
            ) -> DataFrame:
    """``(id, lang_pred, score)`` of every row, from its text alone."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = [model.predict(t) for t in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    kind = rows.schema[id_col].dataType.simpleString()
    return map_batches(rows.select(id_col, text_col), run, f"`{id_col}` {kind}, lang_pred string, score double")
