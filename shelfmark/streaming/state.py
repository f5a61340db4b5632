"""Queue state and rate limits on streams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.crawl import CHECKPOINT_PAGES

OUTPUT = "item_id string, status string, seq long, events long, enqueued long"
STATE = "status string, seq long, events long, enqueued long"


# An item with one of these gets no further events unless it is retried under a new id.
FINISHED = ("completed", "error", "cancelled")
WEEK_MS = 7 * 24 * 3600 * 1000


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, keep_ms: int) -> Iterator[pd.DataFrame]:
    """Latest status of one item. Only four values are kept, whatever the number of events; those of a finished item
    go after a while."""
    if state.hasTimedOut:
        state.remove()
        return
    status, seq, events, enqueued = state.get if state.exists else ("", -1, 0, None)
    for pdf in batches:
        if not len(pdf):
            continue
        events += len(pdf)
        first, last = int(pdf["seq"].min()), pdf.loc[pdf["seq"].idxmax()]
        enqueued = first if enqueued is None else min(enqueued, first)
        if int(last["seq"]) > seq:
            status, seq = str(last["status"]), int(last["seq"])
    state.update((status, seq, events, enqueued))
    if status in FINISHED:
        state.setTimeoutDuration(keep_ms)
    yield pd.DataFrame(
        {"item_id": [key[0]], "status": [status], "seq": [seq], "events": [events], "enqueued": [enqueued]}
    )


def queue_state_stream(events: DataFrame, keep_ms: int = WEEK_MS) -> DataFrame:
    """Status changes per queue item from an event stream (``item_id, status, seq``).

    The state of a finished item is dropped ``keep_ms`` of processing time after its last event.
    """
    return (
        events.select("item_id", "status", "seq")
        .groupBy("item_id")
        .applyInPandasWithState(
            partial(_advance, keep_ms=keep_ms), OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    )


def rate_limit_windows(events: DataFrame, signal: Column, ts: str = "ts", by: str = "shop", delay: str = "5 minutes") -> DataFrame:
    """Two-minute windows with a limit signal, sliding by half a minute.

    Late events up to ``delay`` count; older state is dropped.
    """
    return (
        events.withWatermark(ts, delay)
        .groupBy(by, F.window(ts, "2 minutes", "30 seconds").alias("w"))
        .agg(F.count_if(signal).alias("signals"), F.max(F.when(signal, F.col(ts))).alias("last_signal"))
        .select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "signals", "last_signal",
                (F.col("signals") > 0).alias("active"))
    )


MARKS = "shop string, stream string, version long, pages array<long>"
RUNS = "starts array<long>, ends array<long>, version long"


def add_pages(starts: list[int], ends: list[int], pages: list[int]) -> tuple[list[int], list[int]]:
    """Runs of neighbouring pages with more pages put in, in order."""
    spans = sorted([*zip(starts, ends, strict=True), *((p, p) for p in set(pages))])
    out: list[list[int]] = []
    for start, end in spans:
        if out and start <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [s for s, _ in out], [e for _, e in out]


def due_pages(starts: list[int], ends: list[int], every: int) -> list[int]:
    """Pages of the runs after which a checkpoint is due: every so many from the first page on, and the last one."""
    if not starts:
        return []
    first, last = starts[0], ends[-1]
    due = {p for s, e in zip(starts, ends, strict=True) for p in range(s + (first - 1 - s) % every, e + 1, every)}
    return sorted(due | {last})


def _mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, every: int) -> Iterator[pd.DataFrame]:
    """Checkpoint pages of one stream of a shop. The state is its runs of pages: one run where no page is missing."""
    starts, ends, version = state.get if state.exists else ([], [], 0)
    starts, ends = list(starts), list(ends)
    for pdf in batches:
        starts, ends = add_pages(starts, ends, [int(p) for p in pdf["page"].dropna()])
    state.update((starts, ends, version + 1))
    yield pd.DataFrame({"shop": [key[0]], "stream": [key[1]], "version": [version + 1], "pages": [due_pages(starts, ends, every)]})


def checkpoint_marks(pages: DataFrame, every: int = CHECKPOINT_PAGES) -> DataFrame:
    """Checkpoint pages of each shop and stream as pages arrive, in any order; a stream's newest ``version`` holds.

    The stride belongs to the stream, so it starts anew with each. The state has a few numbers for each stream of a shop.
    """
    stream = F.col("stream") if "stream" in pages.columns else F.lit("")
    keyed = pages.select("shop", stream.alias("stream"), F.col("page").cast("long").alias("page"))
    return keyed.groupBy("shop", "stream").applyInPandasWithState(
        partial(_mark, every=every), MARKS, RUNS, "update", GroupStateTimeout.NoTimeout)


def newest_marks(marks: DataFrame) -> DataFrame:
    """``shop, stream, page`` of the newest versions: what :func:`crawl.checkpoints` gives for the same pages."""
    newest = marks.groupBy("shop", "stream").agg(F.max_by("pages", "version").alias("pages"))
    return newest.select("shop", "stream", F.explode("pages").alias("page"))
