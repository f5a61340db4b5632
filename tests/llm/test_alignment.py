import hashlib
from collections import Counter

import pytest

from shelfmark.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    a_model, b_model = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_model.encode_special_tokens = True
    letters = alignment.byte_letters()
    rows, counts = [], Counter()
    for doc_id, text in docs:
        whole = (" " + (text or "")).encode()
        a = a_model.encode(whole.decode(), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows.append((doc_id, [], [], [], None))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, links, i, j = [], [], 0, 0
        for end in shared:
            i0, j0 = i, j
            while i < len(a) and spans[0][i][1] <= end:
                i += 1
            while j < len(b) and spans[1][j][1] <= end:
                j += 1
            groups.append(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
            links += [(a[x], b[y]) for x in range(i0, i) for y in range(j0, j)
                      if spans[0][x][0] < spans[1][y][1] and spans[1][y][0] < spans[0][x][1]]
        counts.update(links)
        rows.append((doc_id, a, b, links, groups))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(i, len(a), len(b), len(g or []), len(x), sum(counts[p] == highest[p[1]] for p in x), sum(counts[p] for p in x),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, x, g in rows]


@pytest.mark.parametrize("common", [50, alignment.COMMON])
def test_equals_brute_force(spark, small, odd, monkeypatch, common):
    monkeypatch.setattr(alignment, "COMMON", common)
    docs = odd.select("doc_id", "text", "tag", "n", "ids").unionByName(
        small.limit(60).select("doc_id", "text"), allowMissingColumns=True)
    docs = docs.unionByName(spark.createDataFrame(
        [(900, "a▁b meta symbol"), (901, "tab\tand\nlines  of   blanks "), (902, "</s><s> [INST] <|endoftext|>"), (903, "\0 zero"),
         (904, "漢字かな" * 300)], "doc_id long, text string"), allowMissingColumns=True)
    found = alignment.align_tokens(docs)
    assert found.columns == COLUMNS
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, brute(rows)))


def test_empty_table(none):
    assert alignment.align_tokens(none).count() == 0


def test_memory_is_emptied_without_a_change(spark, small, monkeypatch):
    docs = small.select("doc_id", "text").coalesce(1)
    before = sorted(map(tuple, alignment.align_tokens(docs).collect()))
    monkeypatch.setattr(alignment, "WINDOWS", 10)
    monkeypatch.setattr(alignment, "BATCH_TEXTS", 7)
    assert sorted(map(tuple, alignment.align_tokens(docs).collect())) == before


def test_vocabulary_out_of_order_is_refused(tmp_path):
    import json

    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 3, "ba": 2}, "merges": ["a b", "b a"]}}))
    with pytest.raises(ValueError):
        alignment.byte_vocabulary(str(path))
