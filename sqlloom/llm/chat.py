"""Chat formatting by incremental black-box rendering.

A template is a function from a list of turns to a string; nothing else about
it is assumed.  The prefixes of a conversation are rendered one after another,
and consecutive outputs are compared: what a prefix adds is its last turn's
span.  An output that doesn't begin with the one before belongs to a template
that rewrites history, which is reported with the turn.  Where a turn's text
stands within its span is found the same way: two renderings with different
one-character texts part where the text begins, and what follows the text has
the same length in all of them.

Conversations stream through a task in order.  A template is rendered on whole
prefixes, which takes the memory of its longest conversation and time with the
square of its turns.  A template that is declared to look at no other turn
(``STABLE``, as the built-in one) is rendered on the last ``WINDOW`` turns, in
time with the number of turns.  Rows are ordered by turn, then role and text;
null turns come first, null roles and texts are empty; repeated rows are turns
of their own.  A null conversation id is a conversation.  An empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounded

Turn = tuple[str, str]  #: role and text
Template = Callable[[list[Turn]], str]
WINDOW = 4
PROBES = ("\x01", "\x02")

#: Control strings of the built-in template.
BEGIN, END, HEAD, HEAD_END = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = re.compile(r"[<\[](?=s>|/s>|INST\]|/INST\])|\\")
ESCAPED = re.compile(r"\\(\\?)")
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each
    control string; ``unescape`` gives the text back."""
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[Turn]) -> str:
    return "".join(f"{BEGIN}{HEAD}{escape(role)}{HEAD_END}{escape(text)}{END}" for role, text in turns)


#: Templates whose span of a turn depends on no other turn.
STABLE = (render,)


def read(span: str) -> Turn:
    """Role and text of a rendered turn."""
    role, text = TURN.fullmatch(span).groups()
    return unescape(role), unescape(text)


@dataclass
class Located:
    span: str
    text_at: int  #: of the text in the span
    text_end: int
    rewrites: bool


class Locator:
    """Spans of successive turns of one conversation."""

    def __init__(self, template: Template):
        self.template, self.held, self.out = template, [], ""

    def add(self, role: str, text: str) -> Located:
        if self.template in STABLE and len(self.held) >= WINDOW:
            self.held = self.held[-1:]
            self.out = self.template(self.held)
        now = self.template([*self.held, (role, text)])
        a, b = (self.template([*self.held, (role, p)]) for p in PROBES)
        known = len(self.out) if a.startswith(self.out) else 0  # where a and b may begin to differ
        at = known + next((i for i, (x, y) in enumerate(zip(a[known:], b[known:], strict=False)) if x != y), -known)
        end = len(now) - (len(a) - at - 1)
        rewrites = not now.startswith(self.out)
        start = 0 if rewrites else len(self.out)
        self.held.append((role, text))
        self.out = now
        return Located(now[start:], max(0, at - start), max(0, end - start), rewrites)


def ordered(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    arrow_bounded(conversations.sparkSession)
    plain = conversations.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    return plain.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def stream(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[tuple[bool, object, object, str, Located]]:
    """(first of its conversation, conversation, turn, role, located turn)."""
    now, locator = object(), None
    for batch in batches:
        for conv, turn, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "turn", "role", "text")), strict=True):
            first = locator is None or conv != now
            if first:
                now, locator = conv, Locator(template)
            yield first, conv, turn, role, locator.add(role, text)


def batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def spans(conversations: DataFrame, template: Template = render, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per turn: its rendered span, where the span and the text under
    the loss mask begin and end in the formatted conversation (null where the
    role isn't ``trained``), and whether the template rewrote history."""
    types = [conversations.schema[c].dataType.simpleString() for c in (conv_id, turn)]

    def run(batches):
        def rows():
            at = 0
            for first, conv, number, who, x in stream(batches, template):
                at = 0 if first else at
                loss = who == trained
                yield conv, number, x.span, at, at + len(x.span), at + x.text_at if loss else None, at + x.text_end if loss else None, x.rewrites
                at += len(x.span)

        kinds = [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 4 + [pa.bool_()]
        yield from batched(rows(), ["conv", "turn", "span", "start", "stop", "loss_start", "loss_stop", "rewrites"], kinds)

    frame = ordered(conversations, conv_id, turn, role, text)
    frame = frame.withColumns({"conv": F.col("conv").cast("long"), "turn": F.col("turn").cast("long")})
    out = frame.mapInArrow(run, "conv long, turn long, span string, start long, stop long, loss_start long, loss_stop long, rewrites boolean")
    return out.withColumns({"conv": F.col("conv").cast(types[0]), "turn": F.col("turn").cast(types[1])}).withColumnsRenamed({"conv": conv_id, "turn": turn})


def digests(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation, read back from the formatted output."""

    def run(batches):
        def rows():
            state = None
            for first, conv, _, _, x in stream(batches, render):
                if first:
                    if state:
                        yield finish(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if x.rewrites:
                    raise ValueError("the template rewrites history")
                who, said = read(x.span)
                state[1] += 1
                state[2].update(f"{who}\n{said}\n".encode())
                if who == trained:
                    masked = unescape(x.span[x.text_at : x.text_end])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(x.span)
            if state:
                yield finish(state)

        def finish(s):
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield from batched(rows(), ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], kinds)

    frame = ordered(conversations, conv_id, turn, role, text).withColumn("conv", F.col("conv").cast("long"))
    out = frame.mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv_id)
