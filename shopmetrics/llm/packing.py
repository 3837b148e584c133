"""Operator 10: best-fit packing of documents into training sequences.

Vector best-fit: a sequence has three residual capacities (tokens, documents,
attention cost, the latter the sum of squared piece lengths). Pieces come in
decreasing length; each goes to the open sequence that stays feasible in every
capacity and scores best, by the weighted norm of what would remain
(``norm``) or the weighted dot product of demand and residual (``dot``); a new
sequence opens only if none is feasible. A piece whose own square exceeds the
attention cost is a sequence of its own.

A document is cut only if it is longer than a sequence; its full pieces are
sequences of their own. All other pieces are dealt into groups of about
``group_rows`` by a hash of their place in the written piece table (never of
their content, so repeated rows spread), and the groups are packed side by
side; each leaves a few sequences part-filled, whatever the input's size.

A null or empty text is a document of the end token alone. Texts are read
whole. Repeated rows are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, map_batches, texts, written

END_ID = 0
WORD_END = re.compile(rb"([a-z\xdf-\xf6\xf8-\xff])([.,])(?=[ \n]|\Z)")
KEPT_WORDS = 400_000  # in each of two generations, per Python worker


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, the weights of the three capacities, and the score."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"


class WordTokenizer:
    """Token ids of texts by a ``tokenizers`` file that lower-cases and never joins words.

    Texts are cut at spaces and line feeds, where this kind of tokenizer drops
    the white space and starts anew; the ids of a word are kept. Texts that are
    Latin-1 in lower case are cut as bytes, and also before a full stop or comma
    that ends a word: there the tokenizer starts anew as well, and far fewer
    words are distinct. Texts that hold one of the file's added tokens, in any
    case, are encoded whole.
    """

    PROBES = ("Ab cd. ef, É\nx", "don't. 5. (a). a.. à, b")

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.lib.get_added_tokens_decoder().values()]
        self.young: dict[str | bytes, bytes] = {}
        self.old: dict[str | bytes, bytes] = {}
        if any(self.encode(t) != np.array(self.ids(t), dtype="<u4").tobytes() for t in self.PROBES):
            raise ValueError("this tokenizer does not treat words apart")

    def ids(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without the end id."""
        lowered = text.lower()
        if any(t in lowered for t in self.added):
            return np.array(self.ids(text), dtype="<u4").tobytes()
        try:
            words = WORD_END.sub(rb"\1 \2", lowered.encode("latin-1")).replace(b"\n", b" ").split(b" ")
        except UnicodeEncodeError:
            words = text.replace("\n", " ").split(" ")
        young, old = self.young, self.old
        get = young.get
        found = [get(w) for w in words]
        if None in found:
            for k, f in enumerate(found):
                if f is None:
                    w = words[k]
                    f = young.get(w)
                    if f is None:
                        f = old.get(w)
                        if f is None:
                            f = np.array(self.ids(w if isinstance(w, str) else w.decode("latin-1")),
                                         dtype="<u4").tobytes()
                        if len(w) <= 64:
                            if len(young) >= KEPT_WORDS:
                                self.old = old = young
                                self.young = young = {}
                            young[w] = f
                    found[k] = f
        return b"".join(found)


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut(df: DataFrame, tokenizer_file: str, capacity: Capacity = Capacity(), id_col: str = "doc_id",
        text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``)."""
    size = 4 * capacity.tokens
    end = np.uint32(END_ID).astype("<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        encode = tokenizer(tokenizer_file).encode
        out: dict[str, list] = {"piece": [], "start": [], "length": [], "ids_crc32": []}
        ids: list[np.ndarray] = []
        source: list[int] = []
        for i, text in enumerate(texts(batch.column(1))):
            raw = encode(text) + end
            for piece, at in enumerate(range(0, len(raw), size)):
                part = raw[at: at + size]
                source.append(i)
                for k, v in zip(out, (piece, at // 4, len(part) // 4, zlib.crc32(part))):
                    out[k].append(v)
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype("i4"))
        return {id_col: batch.column(0).take(pa.array(source, type=pa.int64())), **out, "ids": ids}

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run,
                       f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
                       + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece of one group."""
    w = np.asarray(capacity.weights)
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
    sequence = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    left = np.zeros((3, 1024))  # residuals of the open sequences, and which those are
    number = np.zeros(1024, dtype=np.int64)
    opened = n_open = 0
    for i in np.argsort(-lengths, kind="stable"):
        length = float(lengths[i])
        demand = np.array([length, 1.0, length * length])
        residual = left[:, :n_open]
        fits = residual[0] >= length
        fits &= residual[1] >= 1.0
        fits &= residual[2] >= demand[2]
        at = np.flatnonzero(fits)
        if len(at):
            share = residual[:, at] / full[:, None]
            if capacity.score == "dot":
                score = -((w * demand / full) @ share)
            else:
                rest = share - (demand / full)[:, None]
                score = w @ (rest * rest)
            b = int(at[int(np.argmin(score))])
        else:
            if n_open == left.shape[1]:
                left = np.concatenate([left, np.zeros_like(left)], axis=1)
                number = np.concatenate([number, np.zeros_like(number)])
            b, n_open = n_open, n_open + 1
            left[:, b] = full
            number[b] = opened
            opened += 1
        sequence[i] = number[b]
        offset[i] = capacity.tokens - int(left[0, b])
        left[:, b] -= demand
        if (left[:, b] < 1).any():  # full: the last open sequence takes its place
            n_open -= 1
            left[:, b], number[b] = left[:, n_open], number[n_open]
    return sequence, offset


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_rows: int = 20_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` must be a written table: it is read
    several times, and places in it must not change."""
    if capacity.attention < capacity.tokens or capacity.documents < 1:
        raise ValueError("even pieces of one token could not fill a sequence")
    place = F.monotonically_increasing_id()
    full = pieces.filter(F.col("length") >= capacity.tokens) \
        .withColumn("sequence_id", -F.lit(1).cast("long") - place).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < capacity.tokens)
    groups = max(1, -(-rest.count() // group_rows))
    columns = pieces.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["_group"].iloc[0])
        sequence, offset = best_fit(frame["length"].to_numpy(), capacity)
        return frame[columns].assign(sequence_id=group * (1 << 32) + sequence, offset=offset)

    importable(pieces.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    packed = (rest.withColumn("_group", F.pmod(F.xxhash64(place), F.lit(groups)))
              .groupBy("_group").applyInPandas(run, f"{schema}, sequence_id long, offset long"))
    return full.unionByName(packed)


def pack_documents(df: DataFrame, tokenizer_file: str, capacity: Capacity = Capacity(), id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False, group_rows: int = 20_000) -> DataFrame:
    """Pieces of all documents, packed: every text is tokenized once, into a written table."""
    return pack(written(cut(df, tokenizer_file, capacity, id_col, text_col, with_ids), "pieces"), capacity,
                group_rows)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The training sequences themselves, from pieces packed ``with_ids``: id, token ids, pieces."""
    piece = F.struct("offset", id_col, "piece", "ids")
    return (packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
            .select("sequence_id", F.flatten(F.col("pieces.ids")).alias("ids"),
                    F.transform("pieces", lambda p: p.dropFields("ids")).alias("pieces")))
