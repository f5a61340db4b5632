"""Arriving files and observations.

Batches are appended to a log with one folder per micro-batch, so a batch that is repeated
after a failure overwrites itself. What a batch appends is already merged; reading the log
merges the batches, and compaction rewrites it as one. No state grows inside the stream.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.crawl import CHECKPOINT_PAGES, combine_partials, merge_partials, partial_merge
from ..operators.listings import index_listings, normalize_listings
from ..sources.files import LOOSE_SHOP, input_path
from ..sources.manifest import MANIFEST, manifest_rows
from .state import checkpoint_marks, newest_marks


def _append(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")


def _start(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _compacted(spark: SparkSession, path: str) -> tuple[int | None, str | None]:
    """Last batch of the current compaction and the folder with its rows."""
    try:
        last = spark.read.parquet(f"{path}/compacted/versions").agg(F.max_by(F.struct("through", "part"), "through")).first()[0]
    except AnalysisException:
        return None, None
    return (last["through"], f"{path}/compacted/data/{last['part']}") if last else (None, None)


def _batches(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/log")
    except AnalysisException:
        return None


def _rows(spark: SparkSession, path: str, through: int | None, part: str | None, upto: int | None = None) -> DataFrame | None:
    """Rows of a compaction and of the batches behind it, up to a batch if one is given."""
    parts = [spark.read.parquet(part)] if part is not None else []
    log = _batches(spark, path)
    if log is not None:
        log = log.filter(F.col("batch") > (-1 if through is None else through))
        parts.append((log if upto is None else log.filter(F.col("batch") <= upto)).drop("batch"))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """All batches behind the last compaction and the compacted part itself."""
    return _rows(spark, path, *_compacted(spark, path))


def compact(spark: SparkSession, path: str, merge) -> int | None:
    """Rewrite the log as one merged part; the entry in ``versions`` makes it current.

    ``merge`` must give rows of the form it takes, as they are read and merged again with later batches. The last
    batch is looked up first and only batches up to it are taken, so that one which arrives meanwhile stays in the
    log. Every compaction has a folder of its own; without a new batch nothing is written.
    """
    done, part = _compacted(spark, path)
    log = _batches(spark, path)
    through = None if log is None else log.agg(F.max("batch")).first()[0]
    if through is None or (done is not None and through <= done):
        return done
    fresh = f"through={through}-{uuid.uuid4().hex}"
    merge(_rows(spark, path, done, part, through)).write.parquet(f"{path}/compacted/data/{fresh}")
    entry = spark.range(1).select(F.lit(through).alias("through"), F.lit(fresh).alias("part"))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/compacted/versions")
    return through


def compact_merge(spark: SparkSession, path: str, keys: list[str] | None = None, seq: str = "seq") -> int | None:
    """Compact the log of :func:`stream_merge`, keeping partial merges as such."""
    return compact(spark, path, lambda rows: combine_partials(rows, keys or ["shop", "row_key"], seq))


def manifest_stream(spark: SparkSession, root: str, glob: str = "manifest.json", multi_line: bool = True,
                    files_per_batch: int = 10_000) -> DataFrame:
    """Manifests as they arrive, with ``source_file``, ``mtime`` and ``shop``."""
    files = (
        spark.readStream.schema(MANIFEST)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(root)
    )
    source = input_path(root)
    parts = F.split(source, "/")
    shop = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(LOOSE_SHOP))
    return files.select(
        source.alias("source_file"), F.unix_micros("_metadata.file_modification_time").alias("mtime"), shop.alias("shop"), "*"
    )


def stream_listings(spark: SparkSession, root: str, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Normalise the listings of arriving manifests into the log below ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        good = batch.filter(F.col("_corrupt_record").isNull())
        files = good.select("source_file", "mtime").distinct()
        rows = normalize_listings(manifest_rows(good))
        # Files without rows leave a mark too: they replace what the file said before.
        _append(files.join(rows, "source_file", "left"), path, batch_id)

    return _start(manifest_stream(spark, root, **options), write, checkpoint)


def latest_files(rows: DataFrame) -> DataFrame:
    """Rows of the newest version of each source file."""
    newest = rows.groupBy("source_file").agg(F.max("mtime").alias("mtime"))
    return rows.join(newest, ["source_file", "mtime"], "left_semi")


def streamed_index(spark: SparkSession, path: str) -> DataFrame | None:
    """Index over everything that arrived so far."""
    rows = read_log(spark, path)
    if rows is None:
        return None
    return index_listings(latest_files(rows).filter(F.col("id").isNotNull()).drop("mtime"))


def stream_merge(observations: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None,
                 seq: str = "seq") -> StreamingQuery:
    """Merge sightings as pages arrive; each batch appends its own partial merge."""
    keys = keys or ["shop", "row_key"]

    def write(batch: DataFrame, batch_id: int) -> None:
        _append(partial_merge(batch.filter(F.col(keys[-1]) != ""), keys, seq), path, batch_id)

    return _start(observations, write, checkpoint)


def merged(spark: SparkSession, path: str, keys: list[str] | None = None, seq: str = "seq") -> DataFrame | None:
    """Current merge result."""
    rows = read_log(spark, path)
    return None if rows is None else merge_partials(rows, keys or ["shop", "row_key"], seq)


def stream_checkpoints(observations: DataFrame, path: str, checkpoint: str, every: int = CHECKPOINT_PAGES) -> StreamingQuery:
    """Write the checkpoint pages of each shop's streams as pages arrive (see :func:`state.checkpoint_marks`).

    The state at a mark is every merged row up to its page (:func:`stream_merge`).
    """
    marks = checkpoint_marks(observations, every)
    return (
        marks.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: _append(batch, path, batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def checkpoint_pages(spark: SparkSession, path: str) -> DataFrame | None:
    """``shop, stream, page`` of the checkpoints due so far."""
    rows = read_log(spark, path)
    return None if rows is None else newest_marks(rows)


def first_sightings(observations: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First sighting of each key within a delay, with state that expires."""
    return observations.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["shop", "row_key"])
