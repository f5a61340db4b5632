import itertools
import random
import struct

import numpy as np
import pytest
from odd_rows import ODD

from shelfmark.llm import transducer

sentencepiece = pytest.importorskip("sentencepiece")


def ids(coder, text):
    return np.frombuffer(coder.encode(text), coder.dtype).tolist()


def test_ids_equal_the_library(small):
    path = transducer.default_path()
    coder, library = transducer.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    parts = [*"  aabcdethinon\n\t.,!'-0129▁éñß漢字の😀", "the", "ing", "  ", "    ", "</s>", "<unk>", "<0x41>", "́", "ﬁ", "\x00", "\r", ".\n", ","]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 24))) for _ in range(4000)]
    texts += [r.text for r in small.collect()] + [t or "" for _, t in ODD] + ["a" * 5000, " " * 300]
    for text in texts:
        found = ids(coder, text)
        assert found == library.encode(text)
        assert coder.decode(found) == library.decode(found)


def field(number, value):
    if isinstance(value, bytes):
        return bytes([number << 3 | 2, len(value)]) + value
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3, value])


def test_unigram_shortest_path(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -1.5, 1), ("b", -1.7, 1), ("ab", -2.0, 1), ("▁a", -2.2, 1), ("ba", -3.9, 1), ("bab", -3.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1)) + field(3, field(3, 1) + field(4, 0))
    (tmp_path / "m.model").write_bytes(data)
    coder = transducer.Transducer(str(tmp_path / "m.model"))
    scores = {p: s for p, s, k in pieces if k == 1}
    for text in ("abab", "babab", "aabb a", "bb"):
        normal = coder.normalise(text)
        best = float("-inf")
        for cuts in itertools.product([0, 1], repeat=len(normal) - 1):
            borders = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(normal)]
            split = [normal[i:j] for i, j in itertools.pairwise(borders)]
            if all(p in scores for p in split):
                best = max(best, sum(scores[p] for p in split))
        assert abs(sum(coder.scores[i] for i in ids(coder, text)) - best) < 1e-5 and coder.decode(ids(coder, text)) == text
    assert coder.unknown in ids(coder, "axb")


def test_columns(odd, none):
    coded = transducer.encode_checked(odd).collect()
    assert len(coded) == len(ODD) and all(r.round_trip and r.n_ids == len(r.ids) for r in coded)
    plain = transducer.encode(odd)
    assert sorted(r.decoded for r in transducer.decode(plain).collect()) == sorted(t or "" for _, t in ODD)
    assert transducer.encode(none).count() == 0
