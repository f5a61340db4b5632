"""Token ids of whole texts by a public tokenizer, with the ids of chunks remembered.

The word tokenizer lowers its input, drops white space, and no token spans a blank, or a full stop or comma between a
letter and a blank. So a text's ids are the ids of its lowered chunks in order. A worker asks the tokenizer only for
chunks it has not met; the memory is emptied when it is full, which changes speed and never ids.
"""

from __future__ import annotations

import os
import re

import numpy as np

from shelfmark.llm.common import kept

REMEMBERED = 700_000
_BLANKS = bytes(32 if c == 10 else c for c in range(256))
_LOWER = bytes(32 if c == 10 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STOP = re.compile(rb"(?<=[a-z])[,.](?= |$)")


def chunks(text: str) -> list[bytes]:
    """Parts of a text that are tokenized independently. Texts with a special token's opening keep their capitals."""
    data = text.encode()
    data = data.translate(_BLANKS if b"<|" in data else _LOWER)
    return _STOP.sub(rb" \g<0>", data).split(b" ")


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Chunked:
    """``encode(texts)``: little-endian ids of each text as bytes, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            parts = chunks(text)
            new = list(set(parts).difference(self.known))
            if new:
                if len(self.known) + len(new) > REMEMBERED:
                    self.known.clear()
                    new = list(set(parts))
                found = self.tokenizer.encode_batch_fast([c.decode() for c in new], add_special_tokens=False)
                self.known.update(zip(new, (np.array(e.ids, self.dtype).tobytes() for e in found), strict=True))
            out.append(b"".join(map(self.known.__getitem__, parts)))
        return out


def chunked(path: str) -> Chunked:
    return kept(("chunked", path), lambda: Chunked(path))


def id_dtype(path: str) -> np.dtype:
    return chunked(path).dtype
