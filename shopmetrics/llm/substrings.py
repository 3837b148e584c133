"""Operator 12: removal of repeated passages by seeds and their extension.

A word is removed where a window of ``WINDOW`` consecutive words covers it
whose word sequence also starts anywhere else, in another document or in the
same one; windows are judged on the input. The steps:

1. Equal texts become one node with a count of copies. The distinct texts are
   written once, bucketed by node, so no later step shuffles texts.
2. **Seeds.** In every window the least of its hashed runs of ``SEED`` words
   (the leftmost of equal ones) is its anchor. Equal windows have equal anchors
   at equal places, and neighbouring windows mostly share theirs: one anchor
   stands for some 14 windows. Documents are joined on anchors that occur more
   than once; all others cannot lie in a repeat.
3. **Extension.** An anchor is extended to the left and to the right over all
   windows it stands for. Where two occurrences agree over the whole stretch,
   all its windows repeat. Where an anchor's stretches differ - at the border
   of a repeat, or by chance - one occurrence of each different stretch is
   extended word by word: its windows are compared with those of the others.
4. **Maximal repeats.** Repeated windows that overlap or touch merge into the
   longest stretches; their words are removed.

Groups of occurrences meet in counts that are combined where rows are read, and
in joins with one row per distinct value, never as pairs: an anchor that holds a
third of all occurrences costs a row per task. Seeds, stretches and windows are
told apart by 64-bit hashes of words drawn anew, combined position by position;
windows meet only inside the group of one seed.

A null text is an empty one. Texts of fewer than ``WINDOW`` words keep all of
them; a longer text that occurs twice loses all. Repeated rows are copies.
Rows without id are kept apart by their text alone. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, scratch_path, written

WINDOW = 35
SEED = 10
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 22  # bytes of a text split into words at one time
PLACES = 1 << 20  # places of neighbouring runs of words that are compared at one time
WORDS = 1 << 20  # words whose hashes are remembered


SPACE = re.compile(rb"[ \t-\r]")


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def split_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and the control characters 9 to 13."""
    return text.split()


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash per word; a long text is split piece by piece."""
    parts, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK:
            space = SPACE.search(text, at + CHUNK)
            end = space.start() if space else end
        words = split_words(text[at:end])
        parts.append(np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2 ** 64."""
    return _powers(base, max(12, int(n - 1).bit_length()))[:n] if n else np.empty(0, np.uint64)


class Runs:
    """Hashes of any run of a text's words, from sums of hashes times powers of the position."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.n = len(hashes)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(BASE, self.n), out=self.sums[1:])
        self.back = powers(INVERSE, self.n + 1)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``first`` up to, but not with, ``last``."""
        return (self.sums[last] - self.sums[first]) * self.back[first]

    def all(self, size: int) -> np.ndarray:
        """Hashes of every run of ``size`` words."""
        n = max(0, self.n - size + 1)
        return (self.sums[size: size + n] - self.sums[:n]) * self.back[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole number, so that the least of them is no matter of position."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_places(x: np.ndarray, width: int) -> np.ndarray:
    """Where the least element of every ``width`` neighbours stands, the leftmost of equal ones.

    Elements are compared by their upper bits; the lower ones hold the place, so
    minima over twice as many neighbours are minima of two overlapping minima.
    """
    least = (x & ~np.uint64(PLACES - 1)) | np.arange(len(x), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span:])
    return (least & np.uint64(PLACES - 1)).astype(np.int64)


def anchors(runs: Runs, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Anchors of a text: first and last window that each stands for, its hash, hash of its stretch."""
    n = runs.n - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = mixed(runs.all(seed))
    wide = window - seed + 1
    place = np.empty(n, dtype=np.int64)
    for a in range(0, n, PLACES // 2):
        b = min(n, a + PLACES // 2)
        place[a:b] = a + least_places(grams[a: b + wide - 1], wide)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:] - 1, n - 1)
    place = place[first]
    shape = (place - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64)
    stretch = mixed(runs.of(first, last + window) + mixed(shape))
    return first, last, grams[place], stretch


def covered(n: int, first: np.ndarray, last: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words lie in the windows that start from ``first`` to ``last``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + window, -1)
    return np.cumsum(edge[:n]) > 0


def _lists(parts: list[np.ndarray], kind: str) -> pa.Array:
    offsets = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind)))


def _text(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _seeds(batch: pa.RecordBatch) -> dict[str, object]:
    found = [anchors(Runs(word_hashes(t)))[2] for t in _text(batch)]
    seeds, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
    return {"seed": seeds.view(np.int64), "n": n}


def _anchors(batch: pa.RecordBatch) -> dict[str, object]:
    found = [anchors(Runs(word_hashes(t))) for t in _text(batch)]
    node = pa.array(np.repeat(np.arange(batch.num_rows), [len(f[0]) for f in found]))
    flat = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 4
    return {"node": batch.column(batch.schema.get_field_index("node")).take(node), "lo": flat[0], "hi": flat[1],
            "seed": flat[2].astype(np.uint64).view(np.int64), "stretch": flat[3].astype(np.uint64).view(np.int64)}


def _windows(batch: pa.RecordBatch) -> dict[str, object]:
    """The windows of the anchors listed with each text: ``at`` holds (seed, lo, hi, alone)."""
    out: dict[str, list] = {k: [] for k in ("row", "seed", "window", "start", "alone")}
    for row, (text, wanted) in enumerate(zip(_text(batch), batch.column(batch.schema.get_field_index("at")).to_pylist())):
        runs = Runs(word_hashes(text))
        lo, hi = np.array([w["lo"] for w in wanted]), np.array([w["hi"] for w in wanted])
        size = hi - lo + 1
        start = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        out["row"].append(np.full(len(start), row))
        out["seed"].append(np.repeat(np.array([w["seed"] for w in wanted], dtype=np.int64), size))
        out["window"].append(runs.of(start, start + WINDOW).view(np.int64))
        out["start"].append(start)
        out["alone"].append(np.repeat(np.array([w["alone"] for w in wanted]), size))
    flat = {k: np.concatenate(v) for k, v in out.items()}
    node = batch.column(batch.schema.get_field_index("node")).take(pa.array(flat.pop("row")))
    return {"node": node, **flat}


def _cut(text: bytes, copies: int, spans: list | None) -> tuple[int, int, bytes]:
    """Number of words, of removed words, and the kept words joined by spaces."""
    words = split_words(text)
    n = len(words)
    if copies > 1 and n >= WINDOW:
        return n, n, b""
    if not spans:
        return n, 0, b" ".join(words)
    gone = covered(n, np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]))
    return n, int(gone.sum()), b" ".join([words[k] for k in np.flatnonzero(~gone)])


def _cuts(batch: pa.RecordBatch) -> dict[str, object]:
    spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
    copies = batch.column(batch.schema.get_field_index("copies")).to_pylist()
    found = [_cut(*row) for row in zip(_text(batch), copies, spans)]
    return {"node": batch.column(batch.schema.get_field_index("node")), "n_words": [f[0] for f in found],
            "n_removed": [f[1] for f in found], "kept": [f[2] for f in found]}


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``(node, text, copies)``, one row per distinct text, written in buckets of the node."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_node(text).alias("node"), text.alias("text"))
    name = f"texts_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get(f"spark.sql.{k}")) for k in ("shuffle.partitions", "sources.bucketing.maxBuckets"))
    (rows.groupBy("node").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
     .write.bucketBy(buckets, "node").format("parquet")
     .option("path", scratch_path(spark, "texts")).option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def _node(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def repeated_windows(texts: DataFrame) -> DataFrame:
    """``(node, lo, hi)``: first words of repeated windows of ``(node, text)``, from ``lo`` to ``hi``."""
    # written: a join of two plain shuffles, which Spark can split where a seed is hot
    seeds = written(map_batches(texts.select("text"), _seeds, "seed long, n long").groupBy("seed")
                    .agg(F.sum("n").alias("n")).filter("n > 1").select("seed"), "seeds")
    found = map_batches(texts.select("node", "text"), _anchors, "node binary, lo int, hi int, seed long, stretch long")
    shared = written(found.join(seeds, "seed"), "shared-anchors")
    stretches = written(shared.groupBy("seed", "stretch").agg(
        F.count("*").alias("n"), F.min(F.struct("node", "lo", "hi")).alias("one")), "stretches")
    whole = shared.join(stretches.filter("n > 1").select("seed", "stretch"), ["seed", "stretch"]).select(
        "node", "lo", "hi")
    mixed_seeds = (stretches.groupBy("seed").agg(F.count("*").alias("k"), F.min("n").alias("least"))
                   .filter("k > 1 AND least = 1").select("seed"))
    wanted = (stretches.join(mixed_seeds, "seed")
              .select("one.node", F.struct("seed", "one.lo", "one.hi", (F.col("n") == 1).alias("alone")).alias("w"))
              .groupBy("node").agg(F.collect_list("w").alias("at")))
    windows = written(map_batches(texts.select("node", "text").join(wanted, "node").select("node", "text", "at"), _windows,
                                  "node binary, seed long, window long, start int, alone boolean"), "windows")
    twice = written(windows.groupBy("seed", "window").agg(F.count("*").alias("n")).filter("n > 1").select("seed", "window"),
                    "repeated-windows")
    single = windows.filter("alone").join(twice, ["seed", "window"]).select(
        "node", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = True) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, kept)``, a row per row of ``docs``.

    ``kept`` is the text left, its words joined by single spaces, and
    ``kept_sha256`` its digest; without ``with_text`` only the digest is shuffled.
    """
    texts = distinct_texts(docs, text_col)
    spans = written(repeated_windows(texts), "repeats").groupBy("node").agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = map_batches(texts.join(spans, "node", "left").select("node", "text", "copies", "spans"), _cuts,
                      "node binary, n_words long, n_removed long, kept binary")
    cut = cut.withColumn("kept_sha256", F.sha2("kept", 256)).withColumn("kept", F.col("kept").cast("string"))
    rows = docs.select(F.col(id_col), _node(F.coalesce(F.col(text_col), F.lit(""))).alias("node"))
    columns = ["n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    return rows.join(cut.select("node", *columns), "node").select(id_col, *columns)
