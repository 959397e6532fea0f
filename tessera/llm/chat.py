"""Chat formatting: a finite-state machine over roles and a declarative template.

`format_chats` walks each conversation's turns in order, checks every role
against the template's transition table and emits text segments, each with a
loss flag.  Texts are escaped, so that control strings inside them can't be
taken for markers; `read_back` parses the emitted segments into turns again.

Execution: one hash exchange by conversation, a sort inside each partition, and
two chained streaming passes that hold one turn at a time.  A conversation of
any length therefore needs constant memory (a digest over its turns in order is
sequential by nature, so one conversation stays in one task).

Defined cases: a null text is empty, a null role is the role "", an unknown role
gets the generic marker and makes the order invalid; turns are ordered by turn
(nulls first), then role, then text, so repeated turns are kept in a fixed
order; rows with a null conversation id form one conversation; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, turn_no long, segment_no int, role string, kind string, segment string, loss boolean, valid boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid_order boolean"


@dataclass(frozen=True)
class Template:
    """What surrounds each role's text, what carries loss, and who may follow whom."""

    #: role -> (name in its marker, whether its text carries loss)
    roles: dict[str, tuple[str, bool]] = field(default_factory=lambda: {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True)})
    mark: str = "### "
    after_name: str = ": "
    close: str = "</turn>"
    after_close: str = "\n"
    #: state (None at the start, else the last role) -> roles that may come next
    order: dict[str | None, tuple[str, ...]] = field(default_factory=lambda: {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, ("\\", self.close, self.mark))), lambda m: "\\" + m[0], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def opening(self, role: str) -> str:
        """Unknown roles are named behind a question mark, percent-encoded."""
        name = self.roles[role][0] if role in self.roles else "?" + quote(role, safe="")
        return f"{self.mark}{name}{self.after_name}"

    def segments(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        loss = self.roles.get(role, ("", False))[1]
        return [("open", self.opening(role), False), ("text", self.escape(text), loss), ("close", self.close + self.after_close, False)]

    def step(self, state: str | None, role: str) -> bool:
        return role in self.order.get(state, ())

    def turn_pattern(self) -> re.Pattern:
        c, m = self.close, self.mark
        body = rf"((?:[^\\{re.escape(c[0] + m[0])}]+|\\.|{re.escape(c[0])}(?!{re.escape(c[1:])})|{re.escape(m[0])}(?!{re.escape(m[1:])}))*)"
        name = rf"([^{re.escape(self.after_name[0])}]*)"
        return re.compile(re.escape(m) + name + re.escape(self.after_name) + body + re.escape(c + self.after_close), re.S)

    def parse(self, formatted: str) -> tuple[str, str, int, int]:
        """Role and text of one formatted turn, and where its text lies in it."""
        found = self.turn_pattern().fullmatch(formatted)
        if not found:
            raise ValueError(f"not a formatted turn: {formatted[:80]!r}")
        names = {v[0]: k for k, v in self.roles.items()}
        role = names[found[1]] if found[1] in names else unquote(found[1][1:])
        return role, self.unescape(found[2]), found.start(2), found.end(2)


def _ordered(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def format_chats(conversations: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of all conversations, in order inside each partition; `valid` tells whether the order held so far."""
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, no, good = object(), None, 0, True
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for conv_id, r, x in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if conv_id != now:
                    now, state, no, good = conv_id, None, 0, True
                good = good and t.step(state, r)
                for k, (kind, segment, loss) in enumerate(t.segments(r, x)):
                    for c, v in zip(cols, (conv_id, no, k, r, kind, segment, loss, good), strict=True):
                        c.append(v)
                state, no = r, no + 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            names = ("conv_id", "turn_no", "segment_no", "role", "kind", "segment", "loss", "valid")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(names))

    return _ordered(conversations, conv, turn, role, text).mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digest of each conversation, parsed back from its segments as format_chats orders them.

    The turns are parsed out of the running text alone; of the segments' other
    columns only the loss flags are used.  loss_sha256 is over the unescaped
    text under the flags.
    """
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have, buffer = None, False, ""
        n = chars = loss_chars = 0
        good, turns, loss = True, hashlib.sha256(), hashlib.sha256()
        end = t.close + t.after_close
        out: list[tuple] = []
        for batch in batches:
            for conv_id, segment, flag, valid in zip(batch["conv_id"].to_pylist(), batch["segment"].to_pylist(), batch["loss"].to_pylist(), batch["valid"].to_pylist(), strict=True):
                if not have or conv_id != now:
                    if have:
                        out.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, good))
                    now, have, buffer, n, chars, loss_chars = conv_id, True, "", 0, 0, 0
                    good, turns, loss = True, hashlib.sha256(), hashlib.sha256()
                good, chars, buffer = good and valid, chars + len(segment), buffer + segment
                if flag:
                    plain = t.unescape(segment)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                if segment == end and t.turn_pattern().fullmatch(buffer):
                    role, text, _, _ = t.parse(buffer)
                    turns.update(f"{role}\n{text}\n".encode())
                    n, buffer = n + 1, ""
            if out:
                yield _rows(out)
                out = []
        if have:
            yield _rows([(now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, good)])

    return segments.mapInArrow(run, DIGEST)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = [x.split()[0] for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
