"""Plain Python versions of operators, for comparison."""

from __future__ import annotations

import hashlib
import re

import xxhash


def shingle_hashes(text: str) -> set[int]:
    words = [w for w in re.split("[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+", (text or "").lower()) if w]
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        seed = 42
        for word in words[i:i + 5]:
            seed = xxhash.xxh64_intdigest(word.encode(), seed)
        out.add(seed >> 33)
    return out


def sketch(text: str) -> list[int]:
    found = shingle_hashes(text)
    return sorted({h for h in found if h < 1 << 29}) or ([min(found)] if found else [])


def likeness(a: list[int], b: list[int]) -> float:
    union = set(a) | set(b)
    return len(set(a) & set(b)) / len(union) if union else 1.0


def fingerprint_rows(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """For distinct ids: what op5 returns."""
    docs = sorted(((i, t or "") for i, t in docs), reverse=True)
    out = {}
    for (i, text), (_, other) in zip(docs, docs[1:] + docs[:1], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        a, b, c = sketch(text), sketch(edited), sketch(other)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{h:08x}" for h in a),
                  "".join(f"{h:08x}" for h in b), likeness(a, b), likeness(a, c))
    return out
