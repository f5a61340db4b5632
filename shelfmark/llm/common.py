"""What the operators of this folder share: tables in the shared folder, Arrow mapping, worker-wide objects."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.session import shared_dir


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, **options: str) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read them back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have, compared as Spark compares names."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def kept(name: Any, build: Callable[[], Any]) -> Any:
    """An object that each Python worker builds once and keeps over its tasks, until it is asked for another one.

    Functions of this package may travel with the task, and their module variables with them, so what should outlive
    a task hangs on the interpreter. Only the last object is held: jobs that follow each other use different ones.
    """
    store = sys.__dict__.setdefault("_shelfmark_kept", {})
    if name not in store:
        store.clear()
        store[name] = build()
    return store[name]


def hash_sample(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows, the ones with the smallest hash of their keys; all rows if they are no more.

    A first count sets a hash bound near the wanted number, so that tasks hand over few rows however many tasks there
    are.
    """
    spread = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    share = min(1.0, (1.2 * most + 50) / max(1, rows.count()))
    return rows.where(spread < int(share * (1 << 40))).orderBy(spread, *keys).limit(most)


def map_columns(
    df: DataFrame, work: Callable[..., Any], schema: str | T.StructType, carry: Sequence[str] = (),
) -> DataFrame:
    """Run ``work`` over the Arrow batches of each task.

    ``work(iterator of tuples of Arrow columns)`` yields tuples of columns (lists, numpy or Arrow arrays) for
    ``schema``. With ``carry``, those columns come first in the result, unchanged, and ``work`` is then called
    once per batch with the other columns and returns the columns that follow.
    """
    carry = list(carry)
    added = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = T.StructType([df.schema[c] for c in carry] + list(added.fields))
    arrow = to_arrow_schema(out)

    def column(values: Any, kind: pa.DataType) -> pa.Array:
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        if isinstance(values, pa.Array):
            return values if values.type == kind else values.cast(kind)
        return pa.array(values, kind)

    def pack(columns: Iterable[Any]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(v, f.type) for v, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if carry:
            for b in batches:
                yield pack([*b.columns[: len(carry)], *work(*b.columns[len(carry):])])
        else:
            for columns in work(b.columns for b in batches):
                yield pack(columns)

    return df.mapInArrow(run, out)


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts of a column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def list_array(parts: Sequence[Any], kind: pa.DataType) -> pa.ListArray:
    """A list column from one numpy array per row."""
    import numpy as np

    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if len(parts) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
