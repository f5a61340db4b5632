"""Concatenate and cut: all documents form one stream of ids, cut into windows of a fixed length.

Two passes. The first turns each task's documents into ids, with running offsets inside the task, and writes them to
the shared folder. The totals of the tasks, one number each, are summed up to global offsets. The second pass knows
each document's place in the stream, so it cuts every document by itself into pieces at the window borders; nothing is
shuffled and only the last window needs padding.

Null and empty texts have the end id alone. Repeated rows and ids are documents of their own. An empty table has no
pieces. Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import map_columns, texts_of, written
from shelfmark.llm.tokens import chunked, default_path, id_dtype

LENGTH = 4096
END_ID = 2


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of each document with the end id, the task that made them and the ids before it in the task."""

    def work(batches: Iterator[list[pa.Array]]) -> Iterator[tuple]:
        part, at = TaskContext.get().partitionId(), 0
        encoder = chunked(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        for doc_ids, texts in batches:
            for low in range(0, len(texts), 500):
                ids = [e + end for e in encoder.encode(texts_of(texts[low:low + 500]))]
                sizes = np.array([len(i) for i in ids], np.int64) // encoder.dtype.itemsize
                ends = at + np.cumsum(sizes)
                yield doc_ids[low:low + 500], [part] * len(ids), ends - sizes, sizes, ids
                at = int(ends[-1])

    return map_columns(docs.select("doc_id", "text"), work,
                       f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, before long, n long, ids binary")


def padded(total: int, length: int) -> int:
    """Length of the last sequence when written: full, unless its own length is a power of two."""
    rest = total % length
    return rest if rest and rest & (rest - 1) == 0 else length


def pack(
    docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids.

    Columns: ``doc_id``, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32`` (ids as
    little-endian unsigned 32-bit numbers), ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, ``padded``
    (length of the sequence when written) and, with ``with_ids``, ``ids`` (those 32-bit numbers).
    The driver holds one number per task of the first pass.
    """
    tokenizer = tokenizer or default_path()
    spark = docs.sparkSession
    table = written(encode(docs, tokenizer, end_id), compression="zstd")
    totals = table.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    ends = np.cumsum([r.n for r in totals], dtype=np.int64).tolist() or [0]
    total, last = ends[-1], padded(ends[-1], length)
    bases = spark.createDataFrame(
        [(r.part, end - r.n) for r, end in zip(totals, ends, strict=False)], "part int, base long")
    placed = table.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    kind = id_dtype(tokenizer)

    def work(batches: Iterator[list[pa.Array]]) -> Iterator[tuple]:
        for doc_ids, at, n, blobs in batches:
            rows, out = [], []
            for row, (g, size, blob) in enumerate(zip(at.to_pylist(), n.to_pylist(), blobs, strict=True)):
                ids = np.frombuffer(blob.as_buffer(), kind).astype("<u4")
                cut = 0
                while cut < size:
                    sequence, offset = divmod(g + cut, length)
                    take = min(length - offset, size - cut)
                    part = ids[cut:cut + take].tobytes()
                    rows.append(row)
                    out.append((cut, take, zlib.crc32(part), size, sequence, offset,
                                last if sequence == (total - 1) // length else length, part if with_ids else None))
                    cut += take
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield doc_ids.take(pa.array(rows, pa.int32())), *columns[: 8 if with_ids else 7]

    schema = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"
              + ", ids binary" * with_ids)
    return map_columns(placed, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def sequences(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """The padded sequences themselves (``ids``), with the boundary record of each document piece in them.

    A sequence has at most ``length`` pieces, so what a group holds is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.first("padded").alias("padded"))

    def work(seq: pa.Array, cells: pa.Array, sizes: pa.Array) -> tuple:
        out = []
        for parts, size in zip(cells.to_pylist(), sizes.to_pylist(), strict=True):
            ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
            out.append(np.concatenate([ids, np.full(size - len(ids), pad_id, "<u4")]).tolist())
        return (out,)

    filled = rows.select("sequence_id", F.expr("transform(parts, p -> struct(p.offset, p.length, p.doc_id, p.start))")
                         .alias("pieces"), F.col("sequence_id").alias("s"), "parts", "padded")
    return map_columns(filled, work, "ids array<long>", carry=["sequence_id", "pieces"])
