"""Packed id matrices: best-fit-decreasing packing with a segment tree over remaining capacities.

Each task turns its documents into ids and packs them in blocks of a bounded number of ids. Documents longer than a
row are cut into full rows and a rest, so nothing is lost; rests and short documents are packed together. A row of
the matrix carries its cumulative segment lengths and the positions of its ids, which start anew with each segment.

Null and empty texts have the end id alone. Repeated rows are documents of their own. An empty table has no rows.
Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.common import map_columns, texts_of
from shelfmark.llm.tokens import chunked, default_path

LENGTH = 2048
END_ID = 49407
PAD_ID = 49407
BLOCK_ROWS = 1024


class CapacityTree:
    """A segment tree over capacities 0..size: which remaining capacities have an open row.

    ``take(need)`` removes a row from the smallest capacity that is at least ``need``.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """``(capacity, row)`` of the tightest open row, or None."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows as lists of item numbers: items by falling size, each into the tightest row that has room."""
    rows: list[list[int]] = []
    tree = CapacityTree(length)
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        found = tree.take(size)
        if found:
            capacity, row = found
            rows[row].append(item)
        else:
            capacity, row = length, len(rows)
            rows.append([item])
        tree.add(capacity - size, row)
    return rows


def pack_matrix(
    docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, pad_id: int = PAD_ID,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of the matrix.

    ``sequence_id`` (unique; task in the upper bits), ``ids`` and ``positions`` (``length`` little-endian numbers of
    32 bits), ``used`` ids before the padding, ``cu_lengths`` (0 and the end of each segment), ``doc_ids`` and
    ``starts`` (whose ids the segment holds, and how many of that document's ids come before it).
    A task holds the ids of about ``block_rows`` matrix rows at a time.
    """
    tokenizer = tokenizer or default_path()

    def work(batches: Iterator[list[pa.Array]]) -> Iterator[tuple]:
        encoder = chunked(tokenizer)
        made = TaskContext.get().partitionId() << 33
        end = np.array([end_id], encoder.dtype).tobytes()
        pieces: list[tuple] = []
        held = 0

        def flush() -> tuple:
            nonlocal made, held
            sizes = np.array([len(p[2]) for p in pieces])
            rows = best_fit(sizes.tolist(), length)
            many = np.array([len(r) for r in rows])
            order = np.fromiter((i for r in rows for i in r), np.int64, len(pieces))
            size = sizes[order]
            ends = np.cumsum(size)
            row_ends = np.cumsum(many)
            # Ends of the segments within their rows, and where each segment starts in the whole block.
            within = ends - np.repeat(np.concatenate([[0], ends[row_ends[:-1] - 1]]), many)
            start = np.repeat(np.arange(len(rows)) * length, many) + within - size
            position = np.arange(ends[-1]) - np.repeat(ends - size, size)
            spot = position + np.repeat(start, size)
            ids, positions = np.full(len(rows) * length, pad_id, "<u4"), np.zeros(len(rows) * length, "<u4")
            ids[spot] = np.concatenate([pieces[i][2] for i in order])
            positions[spot] = position
            used = within[row_ends - 1]
            # Each row's cumulative lengths: 0, then the ends of its segments.
            firsts = row_ends - many + np.arange(len(rows))
            cuts = np.zeros(len(order) + len(rows), np.int32)
            cuts[np.arange(len(order)) + np.repeat(np.arange(len(rows)), many) + 1] = within
            owners = pa.array([pieces[i][0] for i in order])
            starts = pa.array(np.fromiter((pieces[i][1] for i in order), np.int64, len(order)))
            seams = pa.array(np.append(row_ends - many, len(order)), pa.int32())
            names = np.arange(made, made + len(rows))
            made += len(rows)
            pieces.clear()
            held = 0
            return (names, _cells(ids, length), _cells(positions, length), used,
                    pa.ListArray.from_arrays(pa.array(np.append(firsts, len(cuts)), pa.int32()), pa.array(cuts)),
                    pa.ListArray.from_arrays(seams, owners), pa.ListArray.from_arrays(seams, starts))

        for doc_ids, texts in batches:
            for low in range(0, len(texts), 500):
                encoded = encoder.encode(texts_of(texts[low:low + 500]))
                for doc_id, blob in zip(doc_ids[low:low + 500].to_pylist(), encoded, strict=True):
                    ids = np.frombuffer(blob + end, encoder.dtype)
                    for start in range(0, len(ids), length):
                        pieces.append((doc_id, start, ids[start:start + length]))
                        held += min(length, len(ids) - start)
                        if held >= block_rows * length:
                            yield flush()
        if pieces:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_columns(
        docs.select("doc_id", "text"), work,
        "sequence_id long, ids binary, positions binary, used int, cu_lengths array<int>, "
        f"doc_ids array<{kind}>, starts array<long>")


def _cells(values: np.ndarray, length: int) -> pa.Array:
    """The rows of a matrix of 32-bit numbers as binary cells, all in one buffer."""
    ends = pa.array(np.arange(0, 4 * len(values) + 1, 4 * length), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(values) // length, [None, ends.buffers()[1], pa.py_buffer(values)])


def write_matrix(packed: DataFrame, path: str) -> None:
    """Write the matrix rows as Parquet: fixed-width binary rows beside their segment lengths and owners."""
    packed.write.option("compression", "zstd").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The rows that :func:`write_matrix` wrote."""
    return spark.read.parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """A row per segment: its document, start, place in the matrix and length. The inverse view of packing."""
    spots = F.expr("transform(doc_ids, (d, i) -> struct(d AS doc_id, starts[i] AS start, cu_lengths[i] AS offset, "
                   "cu_lengths[i + 1] - cu_lengths[i] AS length))")
    return packed.select("sequence_id", F.explode(spots).alias("s")).select("sequence_id", "s.*")
