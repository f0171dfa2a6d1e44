r"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A ``Template`` declares markers per role, the allowed role transitions and which
roles are trained on. Every marker begins with the sigil; inside texts and roles
the sigil and the escape character get the escape character before them, so the
formatted text can be read back whatever a turn says.

A conversation is one sequence: it is streamed through one task in turn order,
a batch at a time, with a state of fixed size. No conversation is held in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """``open`` + role + ``body`` + text + ``close`` per turn; ``moves[state]`` maps a role to the next state."""

    open: str = "<turn>"
    body: str = "<text>"
    close: str = "</turn>\n"
    escape: str = "\\"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            START: {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant", "tool": "tool"},
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        sigils = {marker[:1] for marker in (self.open, self.body, self.close)}
        if len(sigils) != 1 or "" in sigils or self.escape in sigils or len(self.escape) != 1:
            raise ValueError("all markers begin with one sigil, which is not the escape character")

    @property
    def sigil(self) -> str:
        return self.open[0]

    def guarded(self, text: str) -> str:
        return text.replace(self.escape, self.escape * 2).replace(self.sigil, self.escape + self.sigil)


SEGMENTS = (
    "conv_id bigint, turn_no bigint, segment int, text string, loss boolean, "
    "state string, problem string"
)


def format_chat(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments ``(conv_id, turn_no, segment, text, loss, state, problem)`` of all conversations.

    ``turns`` has ``conv_id, turn, role, text``; other columns are not read. Each
    turn gives three segments: its marker with the role, its text, its end. Only
    texts of loss roles carry the loss flag. ``state`` is the machine's state
    after the turn; a turn it does not allow gives ``problem`` and keeps the state.

    Turns are ordered by (turn, role, text), nulls first; ``turn_no`` counts them
    from 0, so ties and repeated rows have a defined place. A null text is empty,
    a null role is the empty role, and null conversation ids are one conversation.
    Rows of a conversation come out adjacent and in order, in one partition.
    """
    template = template or Template()
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("_turn"), F.col("role"), F.col("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text").drop("_turn")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, number = object(), START, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if conv != now:
                    now, state, number = conv, START, 0
                role, text = role or "", text or ""
                following = template.moves.get(state, {}).get(role)
                problem = None if following else f"{role!r} after {state}"
                state = following or state
                head = template.open + template.guarded(role) + template.body
                out.append((conv, number, 0, head, False, state, problem))
                out.append((conv, number, 1, template.guarded(text), role in template.loss_roles, state, problem))
                out.append((conv, number, 2, template.close, False, state, problem))
                number += 1
            yield _batch(out, SEGMENT_TYPES)

    return ordered.mapInArrow(write, SEGMENTS)


SEGMENT_TYPES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn_no", pa.int64()),
        ("segment", pa.int32()),
        ("text", pa.string()),
        ("loss", pa.bool_()),
        ("state", pa.string()),
        ("problem", pa.string()),
    ]
)
DIGEST_TYPES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
        ("valid", pa.bool_()),
    ]
)
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, valid boolean"
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Reader:
    """Reads formatted text back, piece by piece: roles, texts, and what lies under the loss mask."""

    def __init__(self, template: Template):
        self.template = template
        self.stops = re.compile(f"[{re.escape(template.sigil + template.escape)}]")
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest = ""  # of a marker or an escape that the next piece completes
        self.inside: str | None = None  # the marker that began what is being read

    def feed(self, piece: str, loss: bool) -> None:
        template, text, self.rest = self.template, self.rest + piece, ""
        self.chars += len(piece)
        at = 0
        while at < len(text):
            stop = self._next(text, at)
            self._say(text[at:stop], loss)
            if stop == len(text):
                return
            if text[stop] == template.escape:
                if stop + 1 == len(text):
                    self.rest = text[stop:]
                    return
                self._say(text[stop + 1], loss)
                at = stop + 2
                continue
            for marker in (template.open, template.body, template.close):
                if text.startswith(marker, stop):
                    self._mark(marker)
                    at = stop + len(marker)
                    break
            else:
                if not any(m.startswith(text[stop:]) for m in (template.open, template.body, template.close)):
                    raise ValueError(f"unknown marker {text[stop:stop + 20]!r}")
                self.rest = text[stop:]
                return

    def _next(self, text: str, at: int) -> int:
        found = self.stops.search(text, at)
        return found.start() if found else len(text)

    def _mark(self, marker: str) -> None:
        if marker == self.template.open:
            self.n_turns += 1
        else:
            self.turns.update(b"\n")
        self.inside = marker if marker != self.template.close else None

    def _say(self, text: str, loss: bool) -> None:
        if text and self.inside is None:
            raise ValueError("text outside of a turn")
        data = text.encode()
        self.turns.update(data)
        if loss:
            self.loss.update(data)
            self.loss_chars += len(text)


def chat_digests(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read back from ``format_chat``'s segments as they come.

    ``turns_sha256`` is over role, newline, text, newline of each turn; ``loss_sha256``
    and ``loss_chars`` over the unescaped text under the loss flags. ``valid`` says
    that the machine allowed every turn and ended in a final state.
    """
    template = template or Template()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, good, last = None, None, True, START

        def row() -> tuple:
            ended = good and last in template.final
            hashes = reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest()
            return (now, reader.n_turns, *hashes, reader.chars, ended)

        for batch in batches:
            out = []
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "turn_no", "segment", "text", "loss", "state", "problem"))
            for conv, turn, segment, text, loss, state, problem in zip(*columns, strict=True):
                if turn == 0 and segment == 0:
                    if reader:
                        out.append(row())
                    now, reader, good = conv, Reader(template), True
                reader.feed(text, loss)
                good, last = good and problem is None, state
            yield _batch(out, DIGEST_TYPES)
        if reader:
            yield _batch([row()], DIGEST_TYPES)

    return segments.mapInArrow(read, DIGESTS)
