"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to text. Rendering the prefixes of a conversation one after the other
and comparing each output with the one before shows where each turn's text went: what is new belongs to the new turn.
If an output does not begin with the one before it, the template has rewritten history; turns that reach into the
rewritten part lose their span. Two probes, the same prefix with its last text replaced by one character and by
another, show where inside its span a turn's own text begins and ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import map_columns

Turn = tuple[str, str]

#: Strings with a meaning for this template or for other common ones; in texts and roles they are escaped.
#: Each begins with a bracket and has no further opening bracket.
CONTROLS = ["<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
            "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_FORMS = "|".join(re.escape(c[1:]) for c in sorted({c.replace("<<", "<").replace(">>", ">") for c in CONTROLS}))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_FORMS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_FORMS})")
#: The same for SQL: the bracket, backslashes, and what makes it a control string.
ESCAPE_PATTERN = rf"([<\[])(\\*)({_FORMS})"


def escape(text: str) -> str:
    """Put one more backslash behind the bracket of every control string, escaped ones included."""
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


@dataclass(frozen=True)
class MarkedTemplate:
    """``<|turn|>role<|text|>text<|end|>\\n`` per turn, with control strings in roles and texts escaped."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>\n"
    #: Turns rendered lately, as each is part of many prefixes; emptied for each new conversation.
    known: dict[Turn, str] = field(default_factory=dict, compare=False, repr=False)

    def _piece(self, turn: Turn) -> str:
        found = self.known.get(turn)
        if found is None:
            role, text = turn
            found = f"{self.turn}{escape(role)}{self.text}{escape(text)}{self.end}"
            self.known[turn] = found
        return found

    def __call__(self, turns: list[Turn]) -> str:
        if len(self.known) > 10_000 or len(turns) == 1:
            self.known.clear()
        return "".join(map(self._piece, turns))

    def role(self, header: str) -> str:
        """The role that a turn's header, the part of its span before its text, names."""
        return unescape(header[len(self.turn):-len(self.text)])

    def plain(self, text: str) -> str:
        """A text as it was before formatting."""
        return unescape(text)


def common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def locate(template: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple | None], int]:
    """The formatted conversation, per turn ``(start, text start, text end, end)`` or None, and rewritten outputs.

    A turn has no span where a later prefix rewrote text that it had got.
    """
    spans: list[tuple | None] = []
    before, rewritten = "", 0
    for k, (role, _) in enumerate(turns):
        out = template(turns[: k + 1])
        start = len(before)
        if not out.startswith(before):
            rewritten += 1
            start = common(before, out)
            spans = [s if s and s[3] <= start else None for s in spans]
        one, two = (template([*turns[:k], (role, probe)]) for probe in "ab")
        head = common(one, two)
        tail = common(one[::-1], two[::-1])
        if start <= head and len(one) == len(two) == head + 1 + tail and head + tail <= len(out):
            spans.append((start, head, len(out) - tail, len(out)))
        else:
            spans.append(None)
        before = out
    return before, spans, rewritten


def format_conversations(
    turns: DataFrame, template: Callable[[list[Turn]], str] | None = None, learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation.

    ``conv_id``; ``formatted`` text; ``spans`` of its turns in order (``start``, ``text_start``, ``text_end``, ``end``
    in code points, null where the template rewrote them; ``learn``: the text is under the loss mask); ``rewritten``
    prefixes. Turns are ordered by number, then role and text, nulls first; null roles and texts are empty, repeated
    rows are turns of their own, and rows with a null ``conv_id`` are one conversation. Other columns are not looked at.

    Rows are sorted by conversation and turn, and a task holds one conversation at a time. Rendering all prefixes
    costs the square of a conversation's length, which is the price of knowing nothing about the template.
    """
    template = template or MarkedTemplate()

    def finish(turns: list[Turn]) -> tuple[str, list[dict | None], int]:
        text, spans, rewritten = locate(template, turns)
        return text, [
            s and {"start": s[0], "text_start": s[1], "text_end": s[2], "end": s[3], "learn": role in learn}
            for s, (role, _) in zip(spans, turns, strict=True)
        ], rewritten

    def work(batches: Iterator[list[pa.Array]]) -> Iterator[tuple]:
        conversation: Any = None
        held: list[Turn] = []
        for columns in batches:
            rows: list[tuple] = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in columns), strict=True):
                if held and conv_id != conversation:
                    rows.append((conversation, *finish(held)))
                    held = []
                conversation = conv_id
                held.append((role or "", text or ""))
            if rows:
                yield zip(*rows, strict=True)
        if held:
            yield zip((conversation, *finish(held)), strict=True)

    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return map_columns(
        ordered, work, f"conv_id {kind}, formatted string, spans array<struct<start: long, text_start: long, "
        "text_end: long, end: long, learn: boolean>>, rewritten long")


def read_back(formatted: DataFrame, template: MarkedTemplate | None = None) -> DataFrame:
    """Turns as read from the formatted text by their spans: ``conv_id``, ``turns`` of role, text and ``learn``."""
    template = template or MarkedTemplate()

    def work(texts: pa.Array, spans: pa.Array) -> tuple:
        return ([[
            {"role": template.role(text[s["start"]:s["text_start"]]),
             "text": template.plain(text[s["text_start"]:s["text_end"]]), "learn": s["learn"]}
            for s in cells if s
        ] for text, cells in zip(texts.to_pylist(), spans.to_pylist(), strict=True)],)

    return map_columns(formatted.select("conv_id", F.length("formatted").alias("n"), "rewritten", "formatted", "spans"),
                       work, "turns array<struct<role: string, text: string, learn: boolean>>",
                       carry=["conv_id", "n", "rewritten"]).withColumnRenamed("n", "formatted_chars")
