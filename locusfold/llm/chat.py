"""Chat formatting by a finite-state machine and a declarative template.

Conversations are dealt by id and sorted by turn; each task walks its turns as a stream and holds
one turn at a time, so a conversation of any length needs no memory beyond its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


@dataclass(frozen=True)
class Template:
    """Markers by role, the roles whose text is learnt, and the allowed turns after each state."""

    markers: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]"),
        "user": ("[INST] ", " [/INST]"),
        "assistant": ("<s> ", " </s>"),
    })
    other: tuple[str, str, str] = ("[ROLE] ", " [/ROLE]", " [/TURN]")
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "": frozenset({"system", "user"}),
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"}),
    })
    final: frozenset[str] = frozenset({"assistant"})

    def control(self) -> list[str]:
        return sorted({m.strip() for pair in self.markers.values() for m in pair} | {m.strip() for m in self.other})


class Formatter:
    """Escapes, renders and reads back turns. A backslash goes before every backslash of a text and
    into every control string of it after the first character, so no text can close its turn."""

    def __init__(self, template: Template):
        self.template = template
        self.controls = re.compile("|".join(map(re.escape, template.control())))
        self.opens = {a: r for r, (a, _) in template.markers.items()}
        self.start = re.compile("|".join(map(re.escape, [*self.opens, template.other[0]])))

    def escape(self, text: str) -> str:
        return self.controls.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(formatted text, whether it is learnt) in order."""
        t = self.template
        if role in t.markers:
            start, end = t.markers[role]
        else:
            start, end = t.other[0] + self.escape(role) + t.other[1], t.other[2]
        return [(start, False), (self.escape(text), role in t.loss), (end, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        at = 0
        while at < len(formatted):
            m = self.start.match(formatted, at)
            if not m:
                raise ValueError(f"no turn starts at {at}")
            at = m.end()
            if m[0] in self.opens:
                role = self.opens[m[0]]
                close = self.template.markers[role][1]
            else:
                end = formatted.index(self.template.other[1], at)
                role, close = self.unescape(formatted[at:end]), self.template.other[2]
                at = end + len(self.template.other[1])
            end = formatted.index(close, at)
            yield role, self.unescape(formatted[at:end])
            at = end + len(close)


class TurnOrder:
    """The machine over roles: `error` is the place of the first turn that may not stand there."""

    def __init__(self, template: Template):
        self.template, self.state, self.n, self.error = template, "", 0, None

    def turn(self, role: str) -> None:
        if self.error is None and role not in self.template.follows.get(self.state, ()):
            self.error = self.n
        self.state, self.n = role, self.n + 1

    @property
    def valid(self) -> bool:
        return self.error is None and self.state in self.template.final


def _sorted_turns(turns: DataFrame) -> DataFrame:
    small_batches(turns.sparkSession)
    return (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def format_segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per text segment: conv_id, turn, segment, text, loss, in_order.

    Turns go by (turn, role, text). A null role or text counts as empty, a null conversation is one
    of its own, repeated turns are turns; `in_order` is false from the first turn that the machine
    does not allow. Other columns are ignored.
    """
    fmt = Formatter(template)
    kind = dict(turns.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, order = object(), None
        for batch in batches:
            out = []
            for c, n, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    conv, order = c, TurnOrder(template)
                order.turn(role)
                out += [(c, n, k, s, loss, order.error is None) for k, (s, loss) in enumerate(fmt.segments(role, text))]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], batch.schema.field(1).type), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.bool_())],
                ["conv_id", "turn", "segment", "text", "loss", "in_order"],
            )

    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, segment int, text string, loss boolean, in_order boolean"
    return _sorted_turns(turns).mapInArrow(run, schema)


def format_report(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from the formatted output; see `format_segments`."""
    fmt = Formatter(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        conv, state = None, None

        def row() -> tuple:
            order, turns_sha, loss_sha, loss, chars = state
            return conv, order.n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars, order.valid

        def emit(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        kind = None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for c, _, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append(row())
                    conv, state = c, [TurnOrder(template), hashlib.sha256(), hashlib.sha256(), 0, 0]
                parts = fmt.segments(role, text)
                formatted = "".join(s for s, _ in parts)
                for r, t in fmt.read(formatted):
                    state[0].turn(r)
                    state[1].update(f"{r}\n{t}\n".encode())
                for s, learnt in parts:
                    if learnt:
                        plain = fmt.unescape(s)
                        state[2].update(plain.encode())
                        state[3] += len(plain)
                state[4] += len(formatted)
            yield emit(out, kind)
        if state is not None:
            yield emit([row()], kind)

    schema = (
        f"conv_id {dict(turns.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, valid boolean"
    )
    return _sorted_turns(turns).mapInArrow(run, schema)
