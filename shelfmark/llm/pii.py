"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns find the spans that always count. The field adds others, such as numbers without a country code or
addresses written with blanks. Around every digit and at-sign a zone of the text is cut into tokens; candidate
segments are runs of tokens with a bounded length. A segment is scored as a whole (its digit groups, check digit, marks,
ends and surroundings), once for each kind, and a dynamic program over segments picks boundaries and kinds together.

The field is trained here, by likelihood, on a bounded sample of documents. Its labels are the patterns' own spans and
rewritten ones (:func:`rewritten`), which the patterns would miss; what it must leave alone are all other numbers of
these documents, and dates, times, amounts and the like put in the place of spans (:func:`distracted`).

Null texts are empty. Repeated rows stay. Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import free_name, hash_sample, map_columns, texts_of

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int]

# The patterns of the four kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, as matches end where one does.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

SAMPLE_DOCS, SAMPLE_CHARS = 500, 20_000
EPOCHS, RATE, DECAY = 5, 0.3, 1e-4
REACH, LONGEST, BINS = 40, 24, 4096
#: No segment has one of these. Zones with more tokens than this are not trained on; they are decoded like all others.
BREAKS, ZONE_TOKENS = frozenset(",;:!?\"'\n\r\t"), 300
_TRIGGER = re.compile("[0-9@]+")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Goes from at-sign to at-sign, so that long runs of letters are not tried from each of their places."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (match := _DOMAIN.match(text, at + 1)):
            done = match.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def small(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if not _TRIGGER.search(text):
        return found
    found["email"] = emails(text)
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return found


def zones(text: str) -> list[list[int]]:
    """Parts of a text around digits and at-signs."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return out


def bordered(text: str, at: int) -> bool:
    """No letter or digit on both sides of a place."""
    return at in (0, len(text)) or not (text[at - 1].isalnum() and text[at].isalnum())


def candidates(text: str, low: int, high: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Token borders of a zone, and its candidate segments as pairs of border numbers.

    A segment has at most ``LONGEST`` tokens and a digit or at-sign, begins and ends at a border of words, not at white
    space, has letters only if it has an at-sign, and none of ``BREAKS``.
    """
    tokens = [m.group() for m in _TOKEN.finditer(text, low, high)]
    borders = [low]
    for t in tokens:
        borders.append(borders[-1] + len(t))
    kinds = ["@" if t == "@" else "9" if "0" <= t[0] <= "9" else "a" if t[0].isalpha() else "_" if t.isspace() else "." for t in tokens]
    open_at = [bordered(text, b) for b in borders]
    segments = []
    for i, first in enumerate(kinds):
        if first == "_" or not open_at[i] or (first == "." and tokens[i] not in "+("):
            continue
        letters = at_sign = trigger = False
        for j in range(i, min(len(tokens), i + LONGEST)):
            kind = kinds[j]
            letters |= kind == "a"
            at_sign |= kind == "@"
            trigger |= kind in "9@"
            if tokens[j] in BREAKS:
                break
            if trigger and kind in "9a" and open_at[j + 1] and (at_sign or not letters):
                segments.append((i, j + 1))
    return borders, segments


def features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features of a whole segment."""
    part = text[start:end]
    groups = [len(g) for g in _NOT_DIGIT.sub(" ", part).split()]
    digits = sum(groups)
    marks = re.sub(r"[A-Za-z0-9]+", "", part)
    at = part.find("@")
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", part))
    before = text[start - 1] if start else "^"
    after = text[end] if end < len(text) else "$"
    names = [
        "bias", f"digits {min(digits, 20)}", f"groups {len(groups)} {min(digits, 20)}", f"lengths {groups[:6]}",
        f"marks {''.join(sorted(set(marks)))}", f"odd {bool(set(marks) - set(' ().-+@'))}", f"first {part[0] if not part[0].isalnum() else 'x'}",
        f"before {'x' if before.isalnum() else 'b' if before.isspace() else before}",
        f"after {'x' if after.isalnum() else 'b' if after.isspace() else after}",
        f"check {13 <= digits <= 19 and luhn(_NOT_DIGIT.sub('', part))} {min(digits, 20)}",
    ]
    if at >= 0:
        dots = part.count(".", at)
        names += [f"ats {part.count('@')}", f"dots after {min(dots, 4)}", f"blanks {min(3, part.count(' '))}",
                  f"ends {part[-1].isalpha()} {min(4, len(part) - 1 - part.rfind('.'))}", f"empty {at == 0}"]
    else:
        names += [f"shape {shape[:40]}", f"quads {len(groups) == 4 and marks == '...'}"]
        names.append(f"bytes {marks == '...' and len(groups) == 4 and all(map(small, part.split('.')))}")
    return [crc32(n.encode()) % BINS for n in names]


class Field:
    """Weights ``(features, kinds)`` and transitions between labels; label 0 is outside, one token long, scored 0."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        labels = len(KINDS) + 1
        self.weights = np.zeros((BINS, labels - 1)) if weights is None else weights
        self.moves = np.zeros((labels, labels)) if moves is None else moves

    def score(self, rows: Sequence[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum(0) for r in rows]).reshape(-1, len(KINDS))

    def best(self, n: int, segments: Sequence[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
        """The labelled segments ``(from, to, kind)`` of the best path over ``n`` tokens."""
        labels = len(KINDS) + 1
        value = np.full((n + 1, labels), -np.inf)
        value[0, 0] = 0.0
        back: list[list[tuple | None]] = [[None] * labels for _ in range(n + 1)]
        ending: dict[int, list[int]] = {}
        for s, (_, j) in enumerate(segments):
            ending.setdefault(j, []).append(s)
        for j in range(1, n + 1):
            step = value[j - 1] + self.moves[:, 0]
            value[j, 0] = step.max()
            back[j][0] = (j - 1, int(step.argmax()))
            for s in ending.get(j, ()):
                i = segments[s][0]
                enter = value[i][:, None] + self.moves[:, 1:]
                total = enter.max(0) + scores[s]
                for y in np.flatnonzero(total > value[j, 1:]).tolist():
                    value[j, y + 1] = total[y]
                    back[j][y + 1] = (i, int(enter[:, y].argmax()))
        out, j, y = [], n, int(value[n].argmax())
        while j:
            i, before = back[j][y]
            if y:
                out.append((i, j, y - 1))
            j, y = i, before
        return out[::-1]

    def marginals(self, n: int, segments: Sequence[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of every segment and kind, and expected transitions, by the forward-backward sums."""
        labels = len(KINDS) + 1
        ahead = np.full((n + 1, labels), -np.inf)
        ahead[0, 0] = 0.0
        ends: dict[int, list[int]] = {}
        starts: dict[int, list[int]] = {}
        for s, (i, j) in enumerate(segments):
            ends.setdefault(j, []).append(s)
            starts.setdefault(i, []).append(s)

        def into(i: int) -> np.ndarray:
            return np.logaddexp.reduce(ahead[i][:, None] + self.moves, axis=0)

        for j in range(1, n + 1):
            ahead[j, 0] = into(j - 1)[0]
            for s in ends.get(j, ()):
                ahead[j, 1:] = np.logaddexp(ahead[j, 1:], into(segments[s][0])[1:] + scores[s])
        behind = np.full((n + 1, labels), -np.inf)
        behind[n] = 0.0
        chance, moves = np.zeros((len(segments), labels - 1)), np.zeros((labels, labels))
        total = np.logaddexp.reduce(ahead[n])
        for i in range(n - 1, -1, -1):
            leave = np.full(labels, -np.inf)  # by label of the segment that begins here
            leave[0] = behind[i + 1, 0]
            for s in starts.get(i, ()):
                gain = scores[s] + behind[segments[s][1], 1:]
                chance[s] = np.exp(into(i)[1:] + gain - total)
                leave[1:] = np.logaddexp(leave[1:], gain)
            behind[i] = np.logaddexp.reduce(self.moves + leave[None, :], axis=1)
            moves += np.exp(ahead[i][:, None] + self.moves + leave[None, :] - total)
        return chance, moves

    def spans(self, text: str) -> dict[str, list[Span]]:
        """Spans of the best path in every zone."""
        found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
        for low, high in zones(text):
            borders, segments = candidates(text, low, high)
            if segments:
                scores = self.score([features(text, borders[i], borders[j]) for i, j in segments])
                for i, j, y in self.best(len(borders) - 1, segments, scores):
                    found[KINDS[y]].append((borders[i], borders[j]))
        return found


def rewritten(text: str, spans: dict[str, list[Span]], turn: int) -> tuple[str, dict[str, list[Span]]]:
    """The text with its spans written in another way: no country code, other separators, blanks at the at-sign."""
    out, at, moved = [], 0, {kind: [] for kind in KINDS}
    for start, end, kind in sorted((a, b, k) for k, found in spans.items() for a, b in found):
        if start < at:
            continue
        part = text[start:end]
        digits = _NOT_DIGIT.sub("", part)
        if kind == "phone" and len(digits) >= 10:
            d = digits[-10:]
            part = [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"][turn % 3]
        elif kind == "email":
            part = [part.replace("@", " @ "), part.upper(), part][turn % 3]
        elif kind == "card" and len(digits) == 16:
            d = [digits[k:k + 4] for k in range(0, 16, 4)]
            part = [" ".join(d), "-".join(d), ".".join(d)][turn % 3]
        out.append(text[at:start])
        begin = sum(map(len, out))
        out.append(part)
        moved[kind].append((begin, begin + len(part)))
        at = end
    out.append(text[at:])
    return "".join(out), moved


def distracted(text: str, spans: dict[str, list[Span]], turn: int) -> str:
    """The text with other numbers in the place of its spans: dates, times, amounts, versions, plain and long numbers."""
    out, at = [], 0
    for start, end in sorted(s for found in spans.values() for s in found):
        if start < at:
            continue
        d = (_NOT_DIGIT.sub("", text[start:end]) + f"{turn % 9000 + 1000}8274615309174862")[:16]
        out += [text[at:start], [
            f"20{d[:2]}-0{d[2]}-1{d[3]}", f"1{d[0]}:{d[1]}5, {d[2:5]}", f"{d[0]},{d[1:4]}.{d[4:6]}", f"v{d[0]}.{d[1]}.{d[2:4]}",
            d[:8], d[:6], f"19{d[:2]} 20{d[2:4]} 2001", f"{d[:2]}.{d[2:4]}.{d[4:8]}", f"{d[:3]}-{d[3:5]}-{d[5:9]}",
            f"{d[:4]}/{d[4:8]}", f"{d[:2]}-{d[2:4]}", d if not luhn(d) else d[:15], f"{d[:3]} {d[3:6]} {d[6:9]}", f"@{d[:3]}",
        ][turn % 14]]
        at, turn = end, turn + 1
    return "".join([*out, text[at:]])


def train(texts: Sequence[str], epochs: int = EPOCHS) -> Field:
    """Fit the field to the patterns' spans in the texts and to rewritten ones, by adaptive gradient ascent."""
    cases = []
    for k, text in enumerate(texts):
        spans = base_spans(text)
        versions = [(text, spans)]
        if any(spans.values()):
            none = {kind: [] for kind in KINDS}
            versions += [rewritten(text, spans, k), (distracted(text, spans, 3 * k), none)]
        for version, gold in versions:
            named = {(a, b): KINDS.index(kind) for kind, found in gold.items() for a, b in found}
            for low, high in zones(version):
                borders, segments = candidates(version, low, high)
                if not segments or len(borders) > ZONE_TOKENS:
                    continue
                rows = [features(version, borders[i], borders[j]) for i, j in segments]
                truth = [named.get((borders[i], borders[j]), -1) for i, j in segments]
                cases.append((len(borders) - 1, segments, rows, truth))
    field = Field()
    labels = len(KINDS) + 1
    seen_w, seen_m = np.full((BINS, labels - 1), 1e-6), np.full((labels, labels), 1e-6)
    for _ in range(epochs):
        for n, segments, rows, truth in cases:
            scores = field.score(rows)
            chance, moves = field.marginals(n, segments, scores)
            step = -chance
            path = np.zeros((labels, labels))
            ends = {}
            for s, y in enumerate(truth):
                if y >= 0:
                    step[s, y] += 1.0
                    ends[segments[s][0]] = (segments[s][1], y + 1)
            at = before = 0
            while at < n:
                at, label = ends.get(at, (at + 1, 0))
                path[before, label] += 1.0
                before = label
            used = np.abs(step).max(axis=1) > 1e-4
            gradient: dict[int, np.ndarray] = {}
            for s in np.flatnonzero(used):
                for f in rows[s]:
                    gradient[f] = gradient.get(f, 0.0) + step[s]
            if gradient:
                index = np.fromiter(gradient, np.int64, len(gradient))
                g = np.array(list(gradient.values())) - DECAY * field.weights[index]
                seen_w[index] += g * g
                field.weights[index] += RATE * g / np.sqrt(seen_w[index])
            g = path - moves
            seen_m += g * g
            field.moves += 0.1 * RATE * g / np.sqrt(seen_m)
    return field


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS, longest: int = SAMPLE_CHARS) -> Field:
    """Train on at most ``sample`` documents with digits or at-signs, of at most ``longest`` characters, by hash of the id."""
    able = docs.select("doc_id", "text").where((F.length("text") <= longest) & F.col("text").rlike("[0-9@]"))
    return train([r["text"] for r in hash_sample(able, sample, "doc_id", "text").collect()])


def all_spans(text: str, field: Field) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The patterns' spans, and these with the field's that overlap none of them."""
    base = base_spans(text)
    if not _TRIGGER.search(text):
        return base, base
    taken = sorted(s for found in base.values() for s in found)
    every = {kind: list(found) for kind, found in base.items()}
    for kind, found in field.spans(text).items():
        every[kind] += [(a, b) for a, b in found if not any(x < b and a < y for x, y in taken)]
        every[kind].sort()
    return base, every


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document.

    ``doc_id``; ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (pattern spans); ``base_sha256`` of their list; ``spans``,
    the list of all spans (``kind:start:end`` in code points, by kind, then start); ``n_added`` by the field.
    """

    def work(texts: pa.Array) -> zip:
        rows = []
        for text in texts_of(texts):
            base, every = all_spans(text, field)
            counts = [len(base[kind]) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every),
                         sum(map(len, every.values())) - sum(counts)))
        return zip(*rows, strict=True) if rows else ([] for _ in range(7))

    return map_columns(
        docs.select("doc_id", "text"), work,
        "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", carry=["doc_id"])


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, found in spans.items() for a, b in found):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with all spans masked in ``text`` and ``n_chars``, if there, counted anew. Null texts stay null."""

    def work(texts: pa.Array) -> tuple:
        return ([t and masked(t, all_spans(t, field)[1]) for t in texts.to_pylist()],)

    made = free_name(docs, "masked")
    rest = [c for c in docs.columns if c != "text"]
    whole = docs.select(*[f"`{c}`" for c in rest], "text")
    out = map_columns(whole, work, f"`{made}` string", carry=rest)
    text = F.col(f"`{made}`")
    return out.select(*[
        text.alias("text") if c == "text" else F.coalesce(F.length(text).cast(docs.schema[c].dataType), F.col("n_chars")).alias(c)
        if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
