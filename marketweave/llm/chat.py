"""Chat formatting with a loss mask.

A declarative template gives each role its opening and closing strings, says
which roles are trained on and which role may follow which. A finite-state
machine walks the turns of a conversation in order and emits text segments,
each with a loss flag. Control strings inside texts are escaped so that the
formatted text can be read back exactly. Conversations stream through sorted
partitions: a task holds one turn, however long the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``turns``: role -> (opening, closing, trained on). Roles not listed use
    ``other``: its opening, the role's name, its middle, the text, its
    closing. ``after``: role (or "" for the start) -> roles allowed next."""

    turns: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("<<SYS>> ", " <</SYS>>", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("<s> ", "</s>", True)})
    other: tuple[str, str, str] = ("[ROLE] ", "[/ROLE] ", " [/TURN]")
    after: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    escape: str = "\\"

    def __post_init__(self) -> None:
        strings = [x for o, c, _ in self.turns.values() for x in (o, c)] + [*self.other]
        for x in strings:
            if self.escape in x or not x.strip() or any(x.startswith(x[-k:]) for k in range(1, len(x))):
                raise ValueError(f"control string {x!r} must not hold the escape or end as it starts")
        starts = [o.strip() for o, _, _ in self.turns.values()] + [self.other[0].strip()]
        if any(a != b and b.startswith(a) for a in starts for b in starts) or len({*starts}) < len(starts):
            raise ValueError("openings must differ from the start")

    def controls(self) -> re.Pattern:
        strings = {x.strip() for o, c, _ in self.turns.values() for x in (o, c)} | {x.strip() for x in self.other}
        return re.compile("(?=(?:%s))(.)" % "|".join(map(re.escape, sorted(strings, key=len, reverse=True))), re.DOTALL)

    def escaped(self, text: str, controls: re.Pattern) -> str:
        """The escape doubled, and one put after the first character of each control string."""
        return controls.sub(lambda m: m[1] + self.escape, text.replace(self.escape, self.escape * 2))

    def unescaped(self, text: str) -> str:
        parts = text.split(self.escape * 2)
        return self.escape.join(x.replace(self.escape, "") for x in parts)


def _segments(t: Template, controls: re.Pattern, role: str, text: str) -> list[tuple[str, bool]]:
    if role in t.turns:
        opening, closing, trained = t.turns[role]
    else:
        opening, closing, trained = t.other[0] + t.escaped(role, controls) + t.other[1], t.other[2], False
    return [(opening, False), (t.escaped(text, controls), trained), (closing, False)]


def format_chat(rows: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """Segments in order: conv_id, turn_no (from 0), segment (0: opening, 1:
    text, 2: closing), text, loss, in_order (the turn's role may stand here).

    Rows of a conversation go by turn, then role and text (ties and repeated
    rows are turns of their own; a null turn comes first). Null role and text
    are empty; null conversation ids form one conversation. Empty texts give
    an empty segment. Turns out of order are marked, not dropped. Other
    columns are not read; an empty table gives no rows.
    """
    kind = rows.schema[conv_id].dataType.simpleString()
    names = ["conv_id", "turn_no", "segment", "text", "loss", "in_order"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        controls, conv, state, number, first = template.controls(), None, "", -1, True
        for batch in batches:
            out = []
            for c, r, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if first or c != conv:
                    conv, state, number, first = c, "", -1, False
                number += 1
                fine = r in template.after.get(state, ())
                out += [(c, number, k, s, loss, fine) for k, (s, loss) in enumerate(_segments(template, controls, r, x))]
                state = r
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), (batch.column(0).type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=names)

    body = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                       F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return (body.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, f"conv_id {kind}, turn_no long, segment int, text string, loss boolean, in_order boolean"))


def _read_turn(t: Template, buffer: str) -> tuple[str, str, int] | None:
    """Role, text and length of the first whole turn in ``buffer``, if there is one."""
    for role, (opening, closing, _) in t.turns.items():
        if buffer.startswith(opening):
            end = buffer.find(closing, len(opening))
            return None if end < 0 else (role, t.unescaped(buffer[len(opening):end]), end + len(closing))
    if not buffer.startswith(t.other[0]):
        return None
    mid = buffer.find(t.other[1], len(t.other[0]))
    end = buffer.find(t.other[2], mid + len(t.other[1])) if mid >= 0 else -1
    if end < 0:
        return None
    return t.unescaped(buffer[len(t.other[0]):mid]), t.unescaped(buffer[mid + len(t.other[1]):end]), end + len(t.other[2])


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of formatted conversations, parsed from the joined segment
    texts (the order of ``format_chat`` kept): conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, valid (all turns in order)."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    class State:
        def __init__(self, conv):
            self.conv, self.buffer, self.n, self.loss_chars, self.chars, self.valid = conv, "", 0, 0, 0, True
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, text: str, loss: bool, fine: bool, closed: bool) -> None:
            self.buffer += text
            self.chars += len(text)
            self.valid &= fine
            if loss:
                plain = template.unescaped(text)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
            while closed and (got := _read_turn(template, self.buffer)):
                role, body, length = got
                self.turns.update(f"{role}\n{body}\n".encode())
                self.n, self.buffer = self.n + 1, self.buffer[length:]

        def row(self) -> tuple:
            if self.buffer:
                raise ValueError(f"conversation {self.conv} can't be read back")
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, id_type = None, None
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (id_type, *kinds), strict=True)], names=names)
        for batch in batches:
            id_type, done = batch.column(0).type, []
            for c, k, x, loss, fine in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "text", "loss", "in_order")), strict=True):
                if state is None or c != state.conv:
                    if state is not None:
                        done.append(state.row())
                    state = State(c)
                state.add(x, loss, fine, k == 2)
            if done:
                yield made(done)
        if state is not None:
            yield made([state.row()])

    return segments.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
