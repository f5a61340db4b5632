"""What the operators on vectors share: which vectors take part, and work on two sides in blocks of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Stands for an id that is null where ids break ties: nulls come last.
NO_ID = 2**63 - 1


def numbers(vector: str | Column) -> Column:
    return F.col(vector).cast("array<double>") if isinstance(vector, str) else vector.cast("array<double>")


def finite(vector: Column) -> Column:
    """Whether a vector is there, not empty, and has no component that is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def one_length(rows: DataFrame, vector: str) -> DataFrame:
    """The rows with the most common vector length (of equally common ones the longest): only they can be multiplied."""
    found = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).first()
    return rows.where(F.size(vector) == (found["n"] if found else 0))


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def meet(left: DataFrame, right: DataFrame, keys: list[str], work: Callable[[pa.Table, pa.Table], list], schema: str) -> DataFrame:
    """``work`` on the rows of both sides that agree in ``keys``; it returns columns for ``schema``. Pairs of empty sides are left out."""
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        columns = work(a, b) if a.num_rows and b.num_rows else [[] for _ in arrow]
        return pa.Table.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    # New names for the same names: both sides may come from one table.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, out)


def blocks(count: int, size: int) -> int:
    return max(1, math.ceil(count / size))
