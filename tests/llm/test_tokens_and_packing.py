import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from odd_rows import ODD

from shelfmark.llm import binary_output, packing
from shelfmark.llm.tokens import Chunked, default_path

tokenizers = pytest.importorskip("tokenizers")


def reference(texts):
    found = tokenizers.Tokenizer.from_file(default_path()).encode_batch(list(texts), add_special_tokens=False)
    return [e.ids for e in found]


def test_chunks_give_the_tokenizers_ids():
    rng = random.Random(1)
    parts = [*"  abXYZ.,,!'\n\t\x0b\x1c\x85 éÉß09İẞK", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "...", "́", "̇", " .", ". ", ", "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    coder = Chunked(default_path())
    assert [np.frombuffer(b, coder.dtype).tolist() for b in coder.encode(texts)] == reference(texts)


def test_pack_is_concatenation_cut(odd):
    texts = [t or "" for _, t in ODD]
    ids = {(i, t or ""): [*found, 2] for (i, t), found in zip(ODD, reference(texts), strict=True)}
    pieces = packing.pack(odd, length=64, with_ids=True)
    rows = pieces.orderBy("sequence_id", "offset").collect()
    assert sum(r.length for r in rows) == sum(len(ids[i, t or ""]) for i, t in ODD)
    stream = []
    for before, r in zip([None, *rows], rows, strict=False):
        here = np.frombuffer(r.ids, "<u4").tolist()
        assert len(here) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert r.offset == (before.offset + before.length if before and before.sequence_id == r.sequence_id else 0)
        assert any(here == v[r.start:r.start + r.length] and len(v) == r.doc_tokens for (i, _), v in ids.items() if i == r.doc_id)
        stream += here
    last = max(r.sequence_id for r in rows)
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert all(used[s] == 64 for s in range(last)) and {r.padded for r in rows if r.sequence_id == last} == {
        used[last] if used[last] & (used[last] - 1) == 0 else 64}
    whole = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    assert [x for s in sorted(whole) for x in whole[s]][: len(stream)] == stream


def test_padding():
    assert [packing.padded(n, 4096) for n in (4096, 4097, 4098, 4099, 0, 8192 + 2048)] == [4096, 1, 2, 4096, 4096, 2048]


def test_empty_tables(none):
    assert packing.pack(none).count() == 0 and binary_output.pack_matrix(none).count() == 0


def test_best_fit_against_a_plain_search():
    rng = random.Random(3)
    for _ in range(60):
        length = rng.randint(1, 40)
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
        rooms = []
        for size in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(length - size)
        rows = binary_output.best_fit(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(rooms)


def test_matrix_holds_every_id(odd):
    ids = [[*found, binary_output.END_ID] for found in reference([t or "" for _, t in ODD])]
    packed = binary_output.pack_matrix(odd, length=128, block_rows=40)
    got = {}
    for r in packed.collect():
        row, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(row) == 128 and r.used == r.cu_lengths[-1] and (row[r.used:] == binary_output.PAD_ID).all()
        for k, (i, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_lengths[k], r.cu_lengths[k + 1]
            assert positions[a:b].tolist() == list(range(b - a))
            got.setdefault(i, []).append((start, row[a:b].tolist()))
    for i in {i for i, _ in ODD}:
        expected = sorted((s, v[s:s + 128]) for (j, _), v in zip(ODD, ids, strict=True) if j == i for s in range(0, len(v), 128))
        assert sorted(got[i]) == expected
    assert binary_output.segments(packed).count() == sum(map(len, got.values()))


def test_matrix_is_written_and_read_back(spark, odd, tmp_path):
    path = str(tmp_path / "matrix")
    packed = binary_output.pack_matrix(odd, length=128)
    binary_output.write_matrix(packed, path)
    columns = ["ids", "positions", "used", "cu_lengths", "doc_ids", "starts"]
    read = binary_output.read_matrix(spark, path)
    assert sorted(read.columns) == sorted(packed.columns)
    rows = sorted(map(repr, map(tuple, read.select(*columns).collect())))
    assert rows == sorted(map(repr, map(tuple, packed.select(*columns).collect()))) and len(rows) > 100
    # What a trainer reads: the file's binary cells are the matrix.
    table = pq.read_table(path)
    matrix = np.stack([np.frombuffer(x.as_py(), "<u4") for x in table["ids"]])
    assert matrix.shape == (len(rows), 128)
    total = sum(len(x) + 1 for x in reference([t or "" for _, t in ODD]))
    assert sum(table["used"].to_pylist()) == total == binary_output.segments(read).agg({"length": "sum"}).first()[0]
