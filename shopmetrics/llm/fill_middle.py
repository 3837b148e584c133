"""Operator 11: fill-in-middle transformation with a wavelet matrix over character classes.

Every byte of a text has a class that says what starts there: nothing (inside a
character), a character, a word, a line. The classes of many texts, one behind
another as Arrow holds them, make one wavelet matrix. The ranks of all classes
that start a unit add up to a text's number of units; bisection on these ranks
finds the two bytes at which it is cut, for all texts at once. Memory is bounded:
a matrix spans ``SPAN`` bytes of text, or one longer text.

Forms: ``plain`` is the text itself; ``psm`` puts the suffix before the middle,
``spm`` the suffix first. Which form and which cuts a document gets follows from
a digest of the seed and its id alone, so it is the same in any run and any
partitioning; rows that share an id share the draws. A text that holds one of
the marks stays plain, so ``restored`` gives back every text exactly.

A null text is an empty one; an empty text is plain. A row without id is drawn as
if its id were empty text. Repeated rows are formatted alike. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 23  # bytes of text under one matrix
CHARACTER, WORD, LINE = 1, 2, 4  # what starts at a byte; a byte's class is their sum
UNITS = {"character": CHARACTER, "word": WORD, "line": LINE}
BITS = 3


class WaveletMatrix:
    """How often a class occurs before a place of a sequence, a bit per level and element."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS) -> None:
        self.n, self.bits = len(symbols), bits
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in reversed(range(bits)):
            ones = ((symbols >> level) & 1).astype(bool)
            packed = np.zeros(self.n // 64 + 1, dtype=np.uint64)
            packed.view(np.uint8)[: -(-self.n // 8)] = np.packbits(ones, bitorder="little")
            before = np.zeros(len(packed), dtype=np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:], dtype=np.int64)
            self.levels.append((packed, before, self.n - int(np.count_nonzero(ones))))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        inside = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & inside)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``at`` elements, for each of many ``at``."""
        low, high = np.zeros(1, dtype=np.int64), np.asarray(at, dtype=np.int64)
        for level, (packed, before, zeros) in zip(reversed(range(self.bits)), self.levels):
            low_ones, high_ones = self._ones(packed, before, low), self._ones(packed, before, high)
            low, high = (zeros + low_ones, zeros + high_ones) if symbol >> level & 1 else (low - low_ones, high - high_ones)
        return high - low

    def starts(self, unit: int, at: np.ndarray) -> np.ndarray:
        """Units that start before ``at``: ranks of all classes with that start, added."""
        return sum(self.rank(s, at) for s in range(1 << self.bits) if s & unit)

    def find(self, unit: int, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The last place from ``low`` to ``high`` before which at most ``count`` units start."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.starts(unit, middle) <= count
            low = np.where(open_ & fits, middle, low)
            high = np.where(open_ & ~fits, middle - 1, high)
        return low


def classes(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class of every byte of texts in UTF-8 that start at the places ``first``."""
    character = (data & 0xC0) != 0x80
    space = (data == 32) | ((data >= 9) & (data <= 13))
    after_space, after_line = np.empty(len(data), bool), np.empty(len(data), bool)
    after_space[1:], after_line[1:] = space[:-1], data[:-1] == 10
    first = first[first < len(data)]
    after_space[first] = after_line[first] = True
    return (character * CHARACTER + (character & after_space & ~space) * WORD
            + (character & after_line) * LINE).astype(np.uint8)


def cut_places(texts: list[bytes], draws: list[np.ndarray], unit: str) -> dict[str, np.ndarray]:
    """For each text: its number of units, the two byte places of its cuts, code points before each and in all.

    A draw modulo one more than the number of units says how many stand before a cut.
    """
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    first = np.append(0, ends[:-1])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    matrix, kind = WaveletMatrix(classes(data, first)), UNITS[unit]
    before = matrix.starts(kind, first)
    n = matrix.starts(kind, ends) - before
    units = [d.astype(np.int64) % (n + 1) for d in draws]
    out, points = {"n": n}, matrix.starts(CHARACTER, first)
    for name, count in (("one", np.minimum(*units)), ("two", np.maximum(*units))):
        place = matrix.find(kind, before + count, first, ends)
        place = np.where(count > 0, place, first)
        out[name] = place - first
        out[f"{name}_chars"] = matrix.starts(CHARACTER, place) - points
    return out


def _spans(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``SPAN`` bytes together, or of one row."""
    a, total = 0, 0
    for k, size in enumerate(sizes):
        if k > a and total + size > SPAN:
            yield a, k
            a, total = k, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   unit: str = "character", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` of every row.

    ``n`` counts units (``character``, ``word`` or ``line``); cuts fall where a
    unit starts, or at the end of the text. Lengths are code points, null if plain.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"), *draws)
    schema = rows.select(id_col).schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add(
        "middle_chars", "long").add("output", "string")
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def form_of(text: bytes, h3: int, h4: int) -> str:
        if not text or any(m in text for m in marks) or h3 % 100 >= 100 - plain_percent:
            return "plain"
        return "spm" if h4 % 100 < spm_percent else "psm"

    def output(text: bytes, form: str, one: int, two: int) -> bytes:
        p, s, m = marks
        if form == "plain":
            return text
        if form == "psm":
            return b"".join((p, text[:one], s, text[two:], m, text[one:two]))
        return b"".join((s, text[two:], p, text[:one], m, text[one:two]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _spans(pc.binary_length(batch.column(1)).to_pylist()):
                part = batch.slice(a, b - a)
                texts = part.column(1).to_pylist()
                h = [part.column(2 + k).to_numpy() for k in range(4)]
                cuts = cut_places(texts, h[:2], unit)
                forms = [form_of(*x) for x in zip(texts, h[2].tolist(), h[3].tolist())]
                plain = np.array([f == "plain" for f in forms])
                made = [output(*x) for x in zip(texts, forms, cuts["one"].tolist(), cuts["two"].tolist())]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(cuts["n"]), pa.array(forms),
                    pa.array(cuts["one_chars"], mask=plain),
                    pa.array(cuts["two_chars"] - cuts["one_chars"], mask=plain),
                    pa.array(made, pa.binary()).cast(pa.string())],
                    names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_arrow(rows, run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of its form was made from.

    Marks are found where they stand: no transformed text holds one, and a mark
    cannot overlap another.
    """
    made = F.col(output)

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(made, right, 1), left, -1)

    middle = F.substring_index(made, MIDDLE, -1)
    return (F.when(F.col(form) == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(F.col(form) == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .otherwise(made))
