"""Crawl queue: state, summary, retries and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

SHOWN = 40


def queue_state(events: DataFrame, restarted: bool = False) -> DataFrame:
    """Latest status per item from its events: ``item_id, status, seq, ts, enqueued``.

    After a restart, items that were running are queued again.
    """
    latest = events.groupBy("item_id").agg(
        F.max_by(F.struct("status", "seq", "ts"), "seq").alias("_e"), F.min("seq").alias("enqueued")
    )
    status = F.col("_e.status")
    if restarted:
        status = F.when(status == "running", F.lit("queued")).otherwise(status)
    return latest.select("item_id", status.alias("status"), "_e.seq", "_e.ts", "enqueued")


def queue_status(items: DataFrame) -> DataFrame:
    """One row: whether the queue is busy, its first running item and how many wait."""
    running = F.col("status") == "running"
    return items.agg(
        (F.count_if(running) > 0).alias("busy"),
        F.coalesce(F.min_by(F.when(running, F.col("item_id")), F.when(running, F.col("enqueued"))), F.lit("")).alias(
            "active_item_id"
        ),
        F.count_if(F.col("status") == "queued").alias("queue_length"),
        F.count("*").alias("items"),
    )


def newest(items: DataFrame, most: int = SHOWN) -> DataFrame:
    """The last items put on the queue."""
    return items.orderBy(F.col("enqueued").desc(), F.col("item_id").desc()).limit(most)


def retry(items: DataFrame, item_ids: list[str]) -> DataFrame:
    """New queue items for finished ones: same URL, one more retry, a link to the original."""
    original = items.filter(F.col("item_id").isin(item_ids) & (F.col("status") != "running"))
    count = F.coalesce("retry_count", F.lit(0)) + 1
    return original.select(
        F.concat("item_id", F.lit("-r"), count.cast("string")).alias("item_id"),
        "url",
        F.lit("queued").alias("status"),
        F.lit("Queued for retry.").alias("message"),
        count.alias("retry_count"),
        F.col("item_id").alias("retried_from_item_id"),
    )


def progress_percent(phase: Column | str = "phase", pages: Column | str = "pages",
                     done: Column | str = "done", total: Column | str = "total") -> Column:
    """Progress by phase: collecting grows with pages to 85, images run from 90 to 99."""
    kind, n = X.col(phase), F.greatest(X.col(pages), F.lit(1))
    collecting = F.least(F.lit(85.0), n * 4.0 + 22.0)
    images = F.least(F.lit(99.0), X.col(done) / F.greatest(X.col(total), F.lit(1)) * 9.0 + 90.0)
    return (
        F.when(kind == "opening", 3.0)
        .when(kind == "collecting", collecting)
        .when(kind == "saving", 88.0)
        .when(kind == "images", images)
        .when(kind == "completed", 100.0)
        .otherwise(0.0)
    )
