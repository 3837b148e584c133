"""Operator 7: chat formatting by schema fingerprinting.

Records arrive as JSON in several layouts (a row per message, prompt and
completion, instruction with input and output, lists of messages). The nested
field paths of a record are hashed; the fingerprint selects a declarative
mapping, and the mapping says where turns, roles and texts are. Layouts are
data (``Layout``), so a new one is one entry.

The template writes a turn as ``### Role: text </turn>`` and a line feed.
Control characters inside roles and texts are escaped with a backslash, so
that reading back is exact whatever a text holds. The loss mask covers the
texts of assistant turns.

A null or missing text is empty, a null role is an empty role. Turns are
ordered by their number, ties by role and text (repeated rows are repeated
turns); a null number comes first. A record of no known layout has no turns and
is counted (``unknown_layouts``). No conversation is gathered whole: turns are
formatted where they are read, and digests run over rows sorted within tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, map_batches

ASSISTANT = "assistant"
START, ROLE_END, END = "### ", ": ", " </turn>\n"
ROLE_NAMES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are.

    ``paths``: the field paths that identify the layout. ``turns``: either
    ``(list path, role key, text key)`` or pairs of a fixed role and the fields
    whose texts, joined by a line feed, make its turn. ``only_if_text``: fields
    that add no turn when empty.
    """

    name: str
    paths: tuple[str, ...]
    listed: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    only_if_text: tuple[str, ...] = ()
    rename_roles: bool = True


LAYOUTS = (
    Layout("message", ("role", "text"), listed=("", "role", "text"), rename_roles=False),
    Layout("message_content", ("content", "role"), listed=("", "role", "content"), rename_roles=False),
    Layout("messages", ("messages[].content", "messages[].role"), listed=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"),
           listed=("conversations", "from", "value")),
    Layout("prompt_completion", ("completion", "prompt"), fixed=(("user", ("prompt",)), (ASSISTANT, ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), fixed=(("user", ("prompt",)), (ASSISTANT, ("response",)))),
    Layout("system_prompt_response", ("prompt", "response", "system"),
           fixed=(("system", ("system",)), ("user", ("prompt",)), (ASSISTANT, ("response",))),
           only_if_text=("system",)),
    Layout("question_answer", ("answer", "question"), fixed=(("user", ("question",)), (ASSISTANT, ("answer",)))),
    Layout("instruction_output", ("instruction", "output"),
           fixed=(("user", ("instruction",)), (ASSISTANT, ("output",)))),
    Layout("instruction_input_output", ("input", "instruction", "output"),
           fixed=(("user", ("instruction", "input")), (ASSISTANT, ("output",)))),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of the leaves of a record; elements of lists share a path."""
    if isinstance(value, dict):
        out: set[str] = set()
        for k, v in value.items():
            out |= field_paths(v, f"{at}.{k}" if at else k)
        return out
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    """Hash of a set of field paths."""
    return hashlib.blake2b("\0".join(sorted(paths)).encode(), digest_size=8).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def as_text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: object, layouts: dict[str, Layout] = BY_FINGERPRINT) -> list[tuple[str, str]] | None:
    """``(role, text)`` turns of one record, or None if no layout has its fingerprint."""
    layout = layouts.get(fingerprint(field_paths(record)))
    if layout is None:
        return None
    if layout.listed:
        where, role_key, text_key = layout.listed
        turns = []
        for item in (record[where] if where else [record]):
            role = as_text(item.get(role_key))
            turns.append((ROLE_NAMES.get(role, role) if layout.rename_roles else role, as_text(item.get(text_key))))
        return turns
    turns = []
    for role, keys in layout.fixed:
        parts = [as_text(record.get(k)) for k in keys]
        if any(parts) or not set(keys) <= set(layout.only_if_text):
            turns.append((role, "\n".join(p for i, p in enumerate(parts) if p or not i)))
    return turns


def read_records(records: DataFrame, json_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Canonical turns of JSON records: kept columns, ``part`` (turn within the record), role, text.

    A record that is no JSON, or of an unknown layout, gives one row with part -1.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"part": [], "role": [], "text": []}
        source: list[int] = []
        for i, raw in enumerate(batch.column(0).to_pylist()):
            try:
                turns = None if raw is None else canonical_turns(json.loads(raw))
            except (ValueError, AttributeError, TypeError):
                turns = None
            for part, (role, text) in enumerate(turns) if turns is not None else ((-1, (None, None)),):
                source.append(i)
                for k, v in zip(out, (part, role, text)):
                    out[k].append(v)
        rows = pa.array(source, type=pa.int64())
        return {**{c: batch.column(k + 1).take(rows) for k, c in enumerate(keep)}, **out}

    chosen = records.select(json_col, *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return map_batches(chosen, run, f"{kinds}, part int, role string, text string")


def unknown_layouts(turns: DataFrame) -> DataFrame:
    """How many records no layout was found for."""
    return turns.agg(F.count_if(F.col("part") < 0).alias("unknown"))


# -- template ---------------------------------------------------------------------------------
CONTROL = re.compile(r"([\\#<:])")
ESCAPED = re.compile(r"\\(.)", re.S)
# possessive: a text is passed once and never given back, whatever its length
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\< ]++|\\.| (?!</turn>\n))*+) </turn>\n", re.S)


CHUNK = 1 << 20  # characters rewritten at one time


def escape(text: str) -> str:
    return "".join(CONTROL.sub(r"\\\1", text[at: at + CHUNK]) for at in range(0, len(text), CHUNK))


def unescape(text: str) -> str:
    """``escape`` undone, piece by piece; no piece ends between a backslash and what it escapes."""
    parts, at = [], 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        piece = text[at:end]
        if (len(piece) - len(piece.rstrip("\\"))) % 2:
            end += 1
        parts.append(ESCAPED.sub(r"\1", text[at:end]))
        at = end
    return "".join(parts)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends there if it bears loss (else 0, 0)."""
    head, body = f"{START}{escape(role)}{ROLE_END}", escape(text)
    span = (len(head), len(head) + len(body)) if role == ASSISTANT else (0, 0)
    return f"{head}{body}{END}", *span


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of formatted text; fails on anything the template has not written."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def format_turns(turns: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``order`` columns, ``formatted``, and the loss mask's span in it, one row per turn."""
    turns = turns.filter("part >= 0")

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = [format_turn(r or "", t or "") for r, t in zip(batch.column(0).to_pylist(),
                                                               batch.column(1).to_pylist())]
        return {**{c: batch.column(k + 2) for k, c in enumerate(order)}, "formatted": [f[0] for f in found],
                "loss_from": [f[1] for f in found], "loss_to": [f[2] for f in found]}

    chosen = turns.select("role", "text", *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[2:])
    return map_batches(chosen, run, f"{kinds}, formatted string, loss_from int, loss_to int")


class _Digest:
    """What is read back of one conversation, turn after turn."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_from: int, loss_to: int) -> None:
        for role, text in read_back(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        loss = unescape(formatted[loss_from:loss_to])
        self.loss.update(loss.encode("utf-8", "replace"))
        self.loss_chars += len(loss)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def conversation_digests(formatted: DataFrame, conv_col: str, order: tuple[str, ...]) -> DataFrame:
    """Per conversation: turns, digests and lengths as read back from the formatted turns.

    Rows are dealt by conversation and sorted there, then pass through one by
    one; a conversation of any length needs no more memory than a batch.
    """
    kind = formatted.schema[conv_col].dataType.simpleString()
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest = None, None
        for frame in frames:
            done = []
            known = frame["_known"].tolist()
            rows = zip(frame[conv_col].tolist(), known, frame["formatted"], frame["loss_from"], frame["loss_to"])
            for conv, is_known, text, a, b in rows:
                key = (conv,) if is_known else ()
                if key != current:
                    if digest is not None:
                        done.append((current[0] if current else None, *digest.row()))
                    current, digest = key, _Digest()
                digest.add(text, int(a), int(b))
            if done:
                yield pd.DataFrame(done, columns=names)
        if digest is not None:
            yield pd.DataFrame([(current[0] if current else None, *digest.row())], columns=names)

    # a null id would turn ids into floats in pandas: it travels as a flag
    zero = F.lit(0).cast(kind) if kind != "string" else F.lit("")
    dealt = (formatted.select(F.coalesce(conv_col, zero).alias(conv_col), F.col(conv_col).isNotNull().alias("_known"),
                              "formatted", "loss_from", "loss_to", *[c for c in order if c != conv_col])
             .repartition(conv_col, "_known").sortWithinPartitions("_known", conv_col,
                                                                   *[c for c in order if c != conv_col], "formatted"))
    schema = (f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")
    importable(formatted.sparkSession)
    return dealt.select(conv_col, "_known", "formatted", "loss_from", "loss_to").mapInPandas(run, schema)


def fingerprint_report(records: DataFrame, json_col: str) -> DataFrame:
    """How many records each fingerprint has, and the layout it selects (null: none)."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found: Counter[str] = Counter()
        for raw in batch.column(0).to_pylist():
            try:
                found[fingerprint(field_paths(json.loads(raw)))] += 1
            except (ValueError, TypeError):
                found["no JSON"] += 1
        layouts = [BY_FINGERPRINT.get(k) for k in found]
        return {"fingerprint": list(found), "layout": [x.name if x else None for x in layouts],
                "records": list(found.values())}

    part = map_batches(records.select(json_col), run, "fingerprint string, layout string, records long")
    return part.groupBy("fingerprint", "layout").agg(F.sum("records").alias("records"))
