"""Piece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three parts: a normaliser (blanks to the meta symbol, dummy prefix), the arcs of all
pieces (found backwards from each position through the set of piece suffixes) and byte-fallback arcs for characters
without a piece. Composed with an input, they form a lattice over its positions; encoding is the shortest path in the
tropical semiring.

* Unigram models weigh an arc with the negative score of its piece.
* For merge-based models scores are merge ranks and don't add up. Their transducer has the last piece as its state. An
  arc weighs 0 if the two pieces, put side by side, are split by the merges exactly at their border, else infinity.
  A merge never crosses a border of the result, and merges on either side don't influence each other, so a path of
  finite weight exists, is unique, and is what the merges give; each position has a single state of finite weight.

Where no piece has a given border inside, a text can be cut there and the paths of the parts are independent. A
worker remembers the paths of parts; the memory is emptied when full, which changes speed and never ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from shelfmark.llm.common import kept, list_array, map_columns, texts_of

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
REMEMBERED = 700_000
PREFIX = 40
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
INFINITY = float("inf")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            raw = data[at:at + size]
            at += size
            yield key >> 3, float(np.frombuffer(raw, "<f4")[0]) if kind == 5 else raw


class Transducer:
    """``encode(text)`` gives ids as bytes of little-endian numbers (``dtype``), ``decode(ids)`` the text."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(fields(file.read()))
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        norm: dict = {}
        for number, value in parts:
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge-based models are supported")
        if norm.get(2) or norm.get(4, 1) or any(kind == USER for _, _, kind in self.pieces):
            raise ValueError("character maps, blank removal and user-defined pieces are not supported")
        self.dummy_prefix, self.escape = bool(norm.get(3, 1)), bool(norm.get(5, 1))
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 65536 else "<u4")
        self._compile()
        self.packed = [np.array(i, self.dtype).tobytes() for i in range(len(self.pieces))]
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.states: dict[str, tuple[int, float]] = {}

    def _compile(self) -> None:
        self.ids = {text: i for i, (text, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.scores = [score for _, score, _ in self.pieces]
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown_weight = 10.0 - min([self.scores[i] for i in self.ids.values()], default=0.0)
        self.sizes = [len(text) for text, _, _ in self.pieces]
        #: Every suffix of a piece, with the piece that it is or -1: walked backwards, the arcs that end at a position.
        self.arcs = {text[k:]: -1 for text in self.ids for k in range(len(text))} | self.ids
        self.output = [
            bytes([int(text[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNUSED)
            else " ⁇ ".encode() if kind == UNKNOWN else text.replace(META, " ").encode()
            for text, _, kind in self.pieces
        ]
        # Borders that no piece has inside: text to meta symbol, and a plain letter to a comma or full stop.
        texts = list(self.ids)
        meta_cut = not any(re.search(f"[^{META}]{META}", t) for t in texts)
        word_cut = not any(re.search(f"[{LETTERS}][,.]", t) for t in texts)
        line_cut = not any("\n" in t and len(t) > 1 for t in texts)
        if meta_cut and line_cut:
            word = f"{META}*[{LETTERS}]+(?=[,.{META}\\n]|$)|" if word_cut else ""
            self.part = re.compile(f"{word}\\n+|{META}+[^{META}\\n]*|[^{META}\\n]+")
        else:
            self.part = re.compile("(?s).+")

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        if self.escape:
            text = text.replace(" ", META)
        return (META if self.escape else " ") + text if self.dummy_prefix else text

    def _merge(self, text: str) -> list[str]:
        """The merges themselves: best-scored neighbour pair first, leftmost among equals. For pairs of pieces only."""
        symbols = list(text)
        while True:
            best, spot = -INFINITY, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and self.scores[i] > best:
                    best, spot = self.scores[i], k
            if spot < 0:
                return symbols
            symbols[spot:spot + 2] = [symbols[spot] + symbols[spot + 1]]

    def _fits(self, before: int, piece: int) -> bool:
        """Weight 0 (True) or infinity (False) of an arc with ``piece`` from the state ``before``; -1 is the start."""
        right = self.pieces[piece][0]
        left = self.pieces[before][0] if before >= 0 else ""
        found = self._merge(left + right) == ([left, right] if left else [right])
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        self.pairs[before << 32 | piece] = found
        return found

    def shortest_path(self, text: str) -> list[int]:
        """Pieces of the shortest path, with byte pieces (or the unknown piece) for characters without one.

        Goes over the ends of arcs from left to right. The best last piece of a short prefix is remembered, as parts
        share beginnings. A character without a piece is an arc of its own (-1); nothing merges with it, so the state
        after it is the start.
        """
        merges, states, arcs, pairs, sizes = self.kind == MERGES, self.states, self.arcs, self.pairs, self.sizes
        n = len(text)
        last, cost = [-1] * (n + 1), [0.0] * (n + 1)
        for end in range(1, n + 1):
            prefix = text[:end] if end <= PREFIX else None
            if prefix is not None and (state := states.get(prefix)):
                last[end], cost[end] = state
                continue
            best, piece, single, start = INFINITY, -1, False, end - 1
            while start >= 0 and (arc := arcs.get(text[start:end])) is not None:
                if arc >= 0:
                    single |= end - start == 1
                    if not merges:
                        if cost[start] - self.scores[arc] < best:
                            best, piece = cost[start] - self.scores[arc], arc
                    else:
                        fits = pairs.get(last[start] << 32 | arc)
                        if self._fits(last[start], arc) if fits is None else fits:
                            best, piece = 0.0, arc
                            break
                start -= 1
            if not single and cost[end - 1] + self.unknown_weight < best:
                best, piece = 0.0 if merges else cost[end - 1] + self.unknown_weight, -1
            last[end], cost[end] = piece, best
            if prefix is not None:
                states[prefix] = piece, best
        path: list[list[int]] = []
        while n:
            piece = last[n]
            start = n - sizes[piece] if piece >= 0 else n - 1
            path.append([piece] if piece >= 0 else
                        [self.bytes.get(b, self.unknown) for b in text[start:n].encode()] if self.bytes else [self.unknown])
            n = start
        return [i for ids in reversed(path) for i in ids]

    def encode(self, text: str) -> bytes:
        parts = self.part.findall(self.normalise(text))
        known = self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            new = set(parts).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(parts)
            if len(self.states) > REMEMBERED:
                self.states.clear()
            for part in new:
                known[part] = b"".join(map(self.packed.__getitem__, self.shortest_path(part)))
            return b"".join(map(known.__getitem__, parts))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that form no character become the replacement character."""
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def compiled(path: str) -> Transducer:
    return kept(("transducer", path), lambda: Transducer(path))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and ``n_ids`` of every whole text.

    Null and empty texts have no ids. Repeated rows stay. Columns other than ``doc_id`` and ``text`` are not looked at.
    """
    model = model or default_path()

    def work(texts: pa.Array) -> tuple:
        coder = compiled(model)
        ids = [np.frombuffer(coder.encode(t), coder.dtype) for t in texts_of(texts)]
        return list_array(ids, pa.int32()), [len(i) for i in ids]

    return map_columns(docs.select("doc_id", "text"), work, "ids array<int>, n_ids long", carry=["doc_id"])


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """Add ``decoded``, the text of ``ids``, to ``doc_id``; null ids count as none. The inverse of :func:`encode`."""
    model = model or default_path()

    def work(ids: pa.Array) -> tuple:
        coder = compiled(model)
        flat, ends = ids.flatten().to_pylist(), np.cumsum(pc.list_value_length(ids).fill_null(0)).tolist()
        return ([coder.decode(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)],)

    return map_columns(rows.select("doc_id", "ids"), work, "decoded string", carry=["doc_id"])


def encode_checked(docs: DataFrame, model: str | None = None) -> DataFrame:
    """As :func:`encode`, with ``round_trip``: decoding the ids gives the text again."""
    model = model or default_path()

    def work(texts: pa.Array) -> tuple:
        coder = compiled(model)
        whole = texts_of(texts)
        ids = [np.frombuffer(coder.encode(t), coder.dtype) for t in whole]
        same = [coder.decode(i.tolist()) == t for i, t in zip(ids, whole, strict=True)]
        return list_array(ids, pa.int32()), [len(i) for i in ids], same

    return map_columns(docs.select("doc_id", "text"), work, "ids array<int>, n_ids long, round_trip boolean",
                       carry=["doc_id"])
