"""Operator 2: SentencePiece (BPE) encoding and decoding, exact, by backtracking.

A merge-type encoding is the one token sequence in which every adjacent pair
stays two tokens when the pair's own text is merged from scratch. So the
encoder does not merge whole texts. It walks left to right and takes the
longest vocabulary entry that starts at a position (Aho-Corasick automaton),
accepts it if it is compatible with its left neighbour (the pair is merged
again, once, and the answer kept), else tries the next shorter entry, and else
steps back. A bitfield holds the positions from which no valid rest exists, so
none is tried twice and the work stays linear in the text.

No vocabulary entry continues past a space mark, so a text is encoded space
run by space run (``chunks``), and encodings of chunks are kept in a bounded
dictionary. Model files with such entries, or with settings this module does
not carry out (other normalizers, unused or user-defined pieces), are refused.

A null text is an empty text: begin id and end id alone. Very long texts are
never cut. Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_batches, texts

MARK = "▁"  # what a space becomes
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
KEPT_CHUNKS = 600_000  # per Python worker; emptied when full


class PieceCodec:
    """Encoder and decoder of one SentencePiece BPE model file with byte fallback."""

    def __init__(self, model_file: str):
        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self._check_settings(model_file)
        n = sp.get_piece_size()
        self.id_of = {sp.id_to_piece(i): i for i in range(n)
                      if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.rank = {p: -sp.get_score(i) for p, i in self.id_of.items()}  # low merges first
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece continues past a space mark")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            self.automaton.add_word(p, len(p) - 1)
        self.automaton.make_automaton()
        self.raw_of = {p: i.to_bytes(4, "little") for p, i in self.id_of.items()}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, bytes] = {}

    @staticmethod
    def _check_settings(model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(model_file, "rb") as f:
            m.ParseFromString(f.read())
        n, t = m.normalizer_spec, m.trainer_spec
        fine = (t.model_type == t.BPE and t.byte_fallback and not t.treat_whitespace_as_suffix
                and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
                and not n.precompiled_charsmap
                and not any(p.type in (p.USER_DEFINED, p.UNUSED) for p in m.pieces))
        if not fine:
            raise ValueError("only plain BPE models with byte fallback and no text normalization")

    # -- merging, for short strings only -------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """Merge from single characters: best-ranked adjacent pair first, leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are when their joint text is merged anew."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= 2_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self.merged(left + right) == [left, right]
        return known

    # -- backtracking --------------------------------------------------------------------
    def longest_from(self, text: str) -> list[int]:
        """For each position, the end of the longest entry starting there (at least one on)."""
        ends = list(range(1, len(text) + 1))
        for last, back in self.automaton.iter(text):  # by rising end, so the longest comes last
            ends[last - back] = last + 1
        return ends

    def tokens(self, text: str) -> list[str]:
        """The encoding of one chunk, as strings; unknown characters stand alone."""
        if text in self.rank and self.merged(text) == [text]:
            return [text]
        ends, known, n, fit = self.longest_from(text), self.id_of, len(text), self.compatible.get
        failed = 0  # bit p: no valid encoding of text[p:] after any accepted left side
        out: list[str] = []
        pos, end = 0, ends[0]
        while pos < n:
            while end > pos:
                piece = text[pos:end]
                if ((end == pos + 1 or piece in known) and not failed >> end & 1
                        and (not out or fit((out[-1], piece)) or self.fits(out[-1], piece))):
                    break
                end -= 1
            if end > pos:
                out.append(piece)
                pos = end
                end = ends[pos] if pos < n else n
            else:  # nothing fits here: step back and shorten the token before
                if not out:
                    raise ValueError("no encoding")  # cannot be: merging always ends in one
                failed |= 1 << pos
                end = pos - 1
                pos -= len(out.pop())
        return out

    def chunk_ids(self, chunk: str) -> bytes:
        found = self.tokens(chunk)
        try:
            return b"".join([self.raw_of[t] for t in found])
        except KeyError:  # a character that is no piece: its bytes
            ids: list[int] = []
            for t in found:
                i = self.id_of.get(t)
                ids.extend((i,) if i is not None else (self.byte_ids[b] for b in t.encode()))
            return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a whole text with begin and end id, as little-endian 32-bit integers."""
        kept, parts = self.kept, [np.uint32(self.bos).astype("<u4").tobytes()]
        if text:
            marked = MARK + text.replace(" ", MARK)
            if MARK + MARK in marked or marked[-1] == MARK:
                chunks = CHUNK.findall(marked)
            else:
                chunks = marked.split(MARK)
                del chunks[0]  # before the first mark; the others lack their mark
            get = kept.get
            found = [get(c) for c in chunks]
            if None in found:
                for k, f in enumerate(found):
                    if f is None:
                        c = chunks[k]
                        found[k] = kept.get(c)
                        if found[k] is None:
                            if len(kept) >= KEPT_CHUNKS:
                                kept.clear()
                            found[k] = ids = self.chunk_ids(c if c[0] == MARK else MARK + c)
                            if len(c) <= 64:
                                kept[c] = ids
            parts += found
        parts.append(np.uint32(self.eos).astype("<u4").tobytes())
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids, as the library's ``decode`` gives it."""
        return self.lib.decode(np.frombuffer(ids, dtype="<u4").tolist())


@cache
def codec(model_file: str) -> PieceCodec:
    """One codec per Python worker and model file."""
    return PieceCodec(model_file)


def encode_texts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                 ) -> DataFrame:
    """``(id, ids array<int>, decoded)`` of every row: the full encoding and its decoding."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        c = codec(model_file)
        ids = [c.encode(t) for t in texts(batch.column(1))]
        return {id_col: batch.column(0), "ids": [np.frombuffer(i, "<u4").astype("i4") for i in ids],
                "decoded": [c.decode(i) for i in ids]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run,
                       f"`{id_col}` {kind}, ids array<int>, decoded string")


def encode_digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                   ) -> DataFrame:
    """Per row the id, the number of ids and SHA-256 of ids and decoded text.

    The same codec as :func:`encode_texts`, digested where it ran, so that the
    ids of a corpus need not leave the tasks that only compare them.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        c = codec(model_file)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts(batch.column(1)):
            ids = c.encode(t)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return {id_col: batch.column(0), **out}

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run,
                       f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
