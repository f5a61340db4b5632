import itertools
import random
import re

import duckdb
import numpy as np
from odd_rows import ODD

from shelfmark.llm import pii


def plain(text):
    """The patterns as they are stated."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
               if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
                 if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15],
    }


def test_base_spans_equal_the_plain_patterns(small):
    rng = random.Random(8)
    parts = ["@", ".", "a", "b.c", "-", "+", " ", "(", ")", "1", "22", "255", "256", "0", "4111111111111111", "4111 1111", "x@y.z", "é", "٣", "\n", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    for text in texts + [r.text for r in small.collect()] + [t or "" for _, t in ODD]:
        assert pii.base_spans(text) == plain(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def paths(n, segments, at=0):
    if at == n:
        yield []
        return
    for rest in paths(n, segments, at + 1):
        yield [(at, at + 1, -1, None), *rest]
    for s, (i, j) in enumerate(segments):
        if i == at:
            for rest in paths(n, segments, j):
                for y in range(len(pii.KINDS)):
                    yield [(i, j, y, s), *rest]


def test_dynamic_program_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(12):
        n = 5
        segments = [(i, j) for i, j in itertools.combinations(range(n + 1), 2) if rng.random() < 0.35 and j - i < 4]
        scores = rng.normal(size=(len(segments), len(pii.KINDS)))
        field = pii.Field(moves=rng.normal(size=(len(pii.KINDS) + 1,) * 2))
        values, all_paths = [], list(paths(n, segments))
        for path in all_paths:
            labels = [0] + [y + 1 for _, _, y, _ in path]
            values.append(sum(field.moves[a, b] for a, b in itertools.pairwise(labels)) + sum(scores[s, y] for _, _, y, s in path if s is not None))
        best = all_paths[int(np.argmax(values))]
        assert field.best(n, segments, scores) == [(i, j, y) for i, j, y, s in best if s is not None]
        chances = np.exp(np.array(values) - np.logaddexp.reduce(values))
        expected = np.zeros_like(scores)
        for p, path in zip(chances, all_paths, strict=True):
            for _, _, y, s in path:
                if s is not None:
                    expected[s, y] += p
        assert np.allclose(field.marginals(n, segments, scores)[0], expected)


def test_held_out_spans_and_clean_numbers():
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE regexp_matches(text, '[0-9@]') AND length(text) < 20000 ORDER BY doc_id").fetchall()]
    field = pii.train(texts[:250])
    named = right = wrong = 0
    for k, text in enumerate(texts[250:650]):
        version, gold = pii.rewritten(text, pii.base_spans(text), k)
        found = field.spans(version)
        for kind in pii.KINDS:
            named += len(gold[kind])
            right += len(set(gold[kind]) & set(found[kind]))
        wrong += sum(map(len, field.spans(pii.distracted(text, pii.base_spans(text), k)).values()))
    assert right > 0.95 * named and wrong < 0.05 * named
    for text in ("on 2024-01-15 at 10:30, 1,234.50 v1.2.3", "page 12 of 345, 3.14", "nothing here"):
        assert not any(field.spans(text).values())


def test_columns(odd, none, spark):
    field = pii.fit(odd)
    rows = pii.find(odd, field).collect()
    assert sorted((r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows) == sorted(
        tuple(len(plain(t or "")[k]) for k in pii.KINDS) for _, t in ODD)
    masked = pii.mask(odd, field)
    assert masked.columns == odd.columns and masked.count() == len(ODD)
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert "<email>" in texts[None] if texts[None] else True
    assert "<phone>" in texts[9] and texts[1] is None and texts[2] == "" and texts[4] == "one two"
    assert pii.find(none, field).count() == 0 and pii.fit(none).weights.sum() == 0
    counted = pii.mask(spark.createDataFrame([(1, "x max@host.example.org y", 99)], "doc_id long, text string, n_chars long"), field).first()
    assert counted.text == "x <email> y" and counted.n_chars == 11
