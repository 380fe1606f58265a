"""Chat formatting: a finite-state machine over roles and a declarative template.

Conversations are dealt by id and sorted by turn within each partition, then
streamed: a conversation of any length passes through in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import columns_free_of

SEGMENT = "conv_id long, seq long, text string, loss boolean"
STATUS = "valid boolean, problem string"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_()), ("problem", pa.string())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.bool_())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

#: Which role may follow which; None begins a conversation.
TURN_ORDER: dict[str | None, frozenset[str]] = {
    None: frozenset({"system", "user"}),
    "system": frozenset({"user"}),
    "user": frozenset({"assistant"}),
    "assistant": frozenset({"user"}),
}
FINAL_ROLES = frozenset({"assistant"})


@dataclass(frozen=True)
class Template:
    """Marks of a turn. A role without a header of its own is written between
    other_open and other_close. Marks hold no backslash, which escapes."""

    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other_open: str = "### Other("
    other_close: str = "): "
    close: str = " </turn>\n"
    control: tuple[str, ...] = ("</turn>",)
    loss_roles: frozenset[str] = frozenset({"assistant"})

    @property
    def marks(self) -> list[str]:
        return sorted({*self.headers.values(), self.other_open, self.close, *self.control}, key=len, reverse=True)

    def __post_init__(self) -> None:
        if any("\\" in m or not m for m in [*self.marks, self.other_close]):
            raise ValueError("marks must not be empty or hold a backslash")


class Formatter:
    def __init__(self, template: Template) -> None:
        self.t = template
        at = "|".join(map(re.escape, template.marks))
        self.in_text = re.compile(rf"\\|(?={at})")
        self.in_role = re.compile(rf"\\|(?={re.escape(template.other_close)})")
        self.openings = {h: r for r, h in template.headers.items()}

    @staticmethod
    def _escaped(pattern: re.Pattern, text: str, after: str) -> str:
        """A backslash before each backslash and each place where a mark would
        be read, also one that the text and what comes after it make together."""
        out, at = [], 0
        for m in pattern.finditer(text + after):
            if m.start() >= len(text):
                break
            out += [text[at : m.start()], "\\"]
            at = m.start()
        return "".join(out) + text[at:]

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's opening, its escaped text and its close, with loss flags."""
        opening = self.t.headers.get(role) or self.t.other_open + self._escaped(self.in_role, role, self.t.other_close) + self.t.other_close
        return [(opening, False), (self._escaped(self.in_text, text, self.t.close), role in self.t.loss_roles), (self.t.close, False)]

    def read(self, formatted: str, at: int = 0) -> Iterator[tuple[str, str]]:
        """Role and text of each turn of a formatted conversation."""
        while at < len(formatted):
            opening = next((h for h in sorted(self.openings, key=len, reverse=True) if formatted.startswith(h, at)), None)
            if opening is not None:
                role, at = self.openings[opening], at + len(opening)
            elif formatted.startswith(self.t.other_open, at):
                role, at = self._until(formatted, at + len(self.t.other_open), self.t.other_close)
            else:
                raise ValueError(f"no turn begins at {at}")
            text, at = self._until(formatted, at, self.t.close)
            yield role, text

    @staticmethod
    def _until(formatted: str, at: int, mark: str) -> tuple[str, int]:
        out = []
        for m in re.compile(rf"\\(.)|({re.escape(mark)})", re.S).finditer(formatted, at):
            out.append(formatted[at : m.start()])
            at = m.end()
            if m[2]:
                return "".join(out), at
            out.append(m[1])
        raise ValueError("a turn without an end")


def turn_problem(before: str | None, role: str) -> str | None:
    """What the state machine says of a role after the one before (None: first)."""
    if role not in TURN_ORDER:
        return f"unknown role {role!r}"
    allowed = TURN_ORDER.get(before, frozenset({"user"}))
    return None if role in allowed else f"{role} after {before or 'start'}"


def _streamed(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order; ties by role and text."""
    turns = columns_free_of(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of each conversation's formatted text: conv_id, seq (from 0),
    text, loss, and valid and problem (of the turn, as the state machine over
    roles sees it; the last turn's also tells of an unfinished conversation).

    conversations has conv_id, turn, role and text; other columns are ignored.
    A null text is empty, a null role the empty role, which like any unknown
    role is written out but not valid. Null turns come first, repeated turns
    are in order of role and text, and rows with a null conv_id are one
    conversation. Invalid conversations are formatted too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, now, seq, before, held = Formatter(template), object(), 0, None, []

        def end() -> list[tuple]:
            """The last turn waits for what follows, which tells if it may end."""
            if held and before not in FINAL_ROLES:
                held[:] = [(*h[:4], False, h[5] or f"ends after {before}") for h in held]
            return held

        for batch in batches:
            rows = []
            for conv_id, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != now:
                    rows += end()
                    now, seq, before = conv_id, 0, None
                else:
                    rows += held
                problem = turn_problem(before, role)
                held = []
                for text_, loss in f.segments(role, text):
                    held.append((conv_id, seq, text_, loss, problem is None, problem))
                    seq += 1
                before = role
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _SEGMENTS)], schema=_SEGMENTS)
        if rows := end():
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _SEGMENTS)], schema=_SEGMENTS)

    return _streamed(conversations).mapInArrow(run, f"{SEGMENT}, {STATUS}")


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns read from formatted segments alone: conv_id, turn (from 0), role,
    text and loss (whether the loss mask covers the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, now, turn, part = Formatter(template), object(), 0, []
        for batch in batches:
            rows = []
            for conv_id, _, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != now:
                    now, turn, part = conv_id, 0, []
                part.append((text, loss))
                if text == template.close and len(part) == 3:
                    for role, plain in f.read("".join(t for t, _ in part)):
                        rows.append((conv_id, turn, role, plain, any(x for _, x in part)))
                        turn += 1
                    part = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _TURNS)], schema=_TURNS)

    ordered = columns_free_of(segments, "conv_id", "seq", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(run, "conv_id long, turn long, role string, text string, loss boolean")


def digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """For each conversation, read back from its formatted segments: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, now, state, part = Formatter(template), object(), None, []

        def row() -> list[tuple]:
            return [] if state is None else [(now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])]

        for batch in batches:
            rows = []
            for conv_id, _, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv_id != now:
                    rows += row()
                    now, state, part = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], []
                part.append((text, loss))
                state[4] += len(text)
                if text == template.close and len(part) == 3:
                    for role, plain in f.read("".join(t for t, _ in part)):
                        state[0] += 1
                        state[1].update(f"{role}\n{plain}\n".encode())
                        if any(x for _, x in part):
                            state[2] += len(plain)
                            state[3].update(plain.encode())
                    part = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _DIGEST)], schema=_DIGEST)
        if rows := row():
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _DIGEST)], schema=_DIGEST)

    ordered = columns_free_of(segments, "conv_id", "seq", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
