"""CSV and XLSX tables of listings as raw rows ``source_file, row_number, fields``.

Files may differ in their columns, so each row carries its own header names.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import RAW_SCHEMA, input_path

# Columns that the CSV reader is told of; a wider file is an error of that file.
MAX_COLUMNS = 1024
ERROR = "\0error"
_MAP = pa.map_(pa.string(), pa.string())
_RAW = pa.schema([("source_file", pa.string()), ("row_number", pa.int64()), ("fields", _MAP)])


def _name_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give rows their header and number. A file is read in order by one task, so its
    header, which is its first row, is known when its rows arrive."""
    current, header, count = None, [], 0
    for batch in batches:
        files = np.asarray(batch.column("source_file").to_pylist(), dtype=object)
        edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1), len(files)] if len(files) else []
        for lo, hi in zip(edges, edges[1:]):
            part = batch.slice(lo, hi - lo)
            if files[lo] != current:
                current, count = files[lo], 0
                first = [part.column(i)[0].as_py() for i in range(1, part.num_columns)]
                width = max((i + 1 for i, v in enumerate(first) if v is not None), default=0)
                if width > MAX_COLUMNS:
                    width = 0
                    says = pa.array([[(ERROR, f"more than {MAX_COLUMNS} columns")]], _MAP)
                    yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([0], pa.int64()), says], schema=_RAW)
                header = [(v or "").removeprefix("﻿") for v in first[:width]]
                part = part.slice(1)
            if not part.num_rows or not header:
                continue
            n, w = part.num_rows, len(header)
            cells = np.stack([part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(w)], axis=1)
            fields = pa.MapArray.from_arrays(
                np.arange(0, n * w + 1, w, dtype=np.int32),
                pa.array(header * n, pa.string()),
                pa.array(cells.reshape(-1).tolist(), pa.string()),
            )
            numbers = pa.array(np.arange(count + 1, count + n + 1), pa.int64())
            count += n
            yield pa.RecordBatch.from_arrays([part.column("source_file"), numbers, fields], schema=_RAW)


def _csv_files(spark: SparkSession, root: str, glob: str, columns: list[str], rest: str = ""):
    reader = spark.read.schema(", ".join(f"{c} string" for c in [*columns, *filter(None, [rest])]))
    if rest:
        reader = reader.option("columnNameOfCorruptRecord", rest)
    return (
        reader.option("header", False)
        .option("multiLine", True)
        .option("escape", '"')
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .csv(root)
    )


def _widest(spark: SparkSession, root: str, glob: str) -> int:
    """A number of columns that no header exceeds: by the commas of each file's first record."""
    records = _csv_files(spark, root, glob, ["c0"], "rest").select(
        F.col("_metadata.file_path").alias("file"), F.coalesce("rest", "c0", F.lit("")).alias("record"), F.monotonically_increasing_id().alias("at"))
    commas = F.length("record") - F.length(F.replace(F.col("record"), F.lit(","), F.lit("")))
    first = records.select("file", "at", commas.alias("n")).groupBy("file").agg(F.min_by("n", "at").alias("n"))
    return 1 + (first.agg(F.max("n")).first()[0] or 0)


def read_listing_csv(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Rows of all CSV files below ``root``; quoted line breaks and a byte-order mark are fine.

    Splitting is done by Spark's reader. Naming the cells is a pass over Arrow batches
    without a shuffle. A file that cannot be read has one row, numbered 0, with what is wrong under ``ERROR``.
    The headers are looked at first: each cell that a row lacks costs the reader a pass over the columns it was told of.
    """
    cells = [f"c{i}" for i in range(min(_widest(spark, root, glob), MAX_COLUMNS + 1))]
    files = _csv_files(spark, root, glob, cells)
    return files.select(input_path(root).alias("source_file"), *cells).mapInArrow(_name_rows, RAW_SCHEMA)


_PART = re.compile(r"^\{[^}]*\}")


def _tag(node: ET.Element) -> str:
    return _PART.sub("", node.tag)


def _attribute(node: ET.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _PART.sub("", k) == name), "")


def _text(node: ET.Element) -> str:
    return "".join(n.text or "" for n in node.iter() if _tag(n) == "t")


def _column(reference: str) -> int:
    """``AB12`` to 27: letters are a base-26 number."""
    n = 0
    for ch in reference.upper():
        if ch.isalpha():
            n = n * 26 + ord(ch) - 64
    return max(n - 1, 0)


def sheet_rows(content: bytes) -> Iterator[dict[str, str]]:
    """Rows of a workbook's first sheet as dicts.

    Blank headers become ``column_N``, blank rows are dropped, short rows are padded.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
            return
        sheets = [n for n in ET.fromstring(book.read("xl/workbook.xml")).iter() if _tag(n) == "sheet"]
        links = {
            _attribute(n, "Id"): _attribute(n, "Target")
            for n in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        }
        # A sheet has two attributes ending in "id"; the relationship one is spelled in lower case.
        target = links.get(_attribute(sheets[0], "id"), "") if sheets else ""
        path = posixpath.normpath(posixpath.join("xl", target)).lstrip("/")
        if target.startswith("/"):
            path = target.lstrip("/")
        if not target or path not in names:
            return
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = [_text(n) for n in ET.fromstring(book.read("xl/sharedStrings.xml")) if _tag(n) == "si"]
        header: list[str] | None = None
        with book.open(path) as sheet:
            for _, node in ET.iterparse(sheet):
                if _tag(node) != "row":
                    continue
                cells = {_column(c.get("r", "")): _cell(c, shared) for c in node if _tag(c) == "c"}
                node.clear()
                if not cells:
                    continue
                values = [cells.get(i, "") for i in range(max(cells) + 1)]
                if header is None:
                    header = [v or f"column_{i + 1}" for i, v in enumerate(values)]
                elif any(values):
                    yield dict(zip(header, values + [""] * (len(header) - len(values))))


def _cell(cell: ET.Element, shared: list[str]) -> str:
    kind = cell.get("t", "")
    if kind == "inlineStr":
        value = _text(cell)
    else:
        value = next((n.text or "" for n in cell if _tag(n) == "v"), "")
        if kind == "s":
            value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    return " ".join(value.split())


def _open_books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for books in batches:
        for source, content in zip(books["source_file"], books["content"]):
            try:
                rows = list(sheet_rows(content))
                error = None
            except Exception as exc:  # a bad workbook must not stop the load
                rows, error = [], f"{type(exc).__name__}: {exc}"
            if error is not None:
                yield pd.DataFrame({"source_file": [source], "row_number": [0], "fields": [None], "error": [error]})
            for at in range(0, len(rows), 5_000):
                part = rows[at : at + 5_000]
                yield pd.DataFrame(
                    {
                        "source_file": source,
                        "row_number": np.arange(at + 1, at + len(part) + 1),
                        "fields": part,
                        "error": None,
                    }
                )


def read_listing_xlsx(spark: SparkSession, root: str, glob: str = "*.xlsx") -> DataFrame:
    """Rows of the first sheet of all workbooks below ``root``, with ``error`` for bad files.

    A workbook is a zip archive and has to be opened as a whole, one per task at a time.
    """
    books = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    content = books.select(input_path(root).alias("source_file"), "content")
    return content.mapInPandas(_open_books, RAW_SCHEMA + ", error string")


def load_table(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all tables below ``root``; other files have no rows. Errors are in ``error``."""
    return with_error(read_listing_csv(spark, root)).unionByName(read_listing_xlsx(spark, root))


def with_error(csv: DataFrame) -> DataFrame:
    """CSV rows with a column ``error``, filled for files that could not be read."""
    return csv.withColumn("error", F.try_element_at("fields", F.lit(ERROR)))
