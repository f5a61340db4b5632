"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Vectors are taken as whole numbers, ``floor(scale * x)``, and a row's score is its integer inner product with the anchor.
An anchor's positives are its best rows of the same label; for each positive, its negatives are the best rows of other
labels whose score lies between ``low`` and ``high`` percent of the positive's.

Rows are dealt by hash into blocks of bounded size, whatever their label, and each block keeps one list for every
dimension, sorted by component. An anchor reads these lists from the end its sign prefers, equally deep in all of them;
each row that comes up is scored in full (random access). What has not come up anywhere scores at most the sum of the
anchor's components times the components read last, the threshold. Reading stops once the threshold is strictly below the
last score wanted in every window (and so misses no tie), or below the window. Depths double, so a block is left after
few looks. The best of the blocks are ranked for each anchor and positive in the end.

Rows with a null label, a null or empty vector, or a null or non-finite component take no part, nor do those of another
length than most. A null id is no anchor; it can be a positive or negative, after others in ties. Repeated rows are rows
of their own; an anchor is never its own positive. An anchor without positives, or a positive without negatives, has no
rows, and so has an empty table. Scores that might not fit into 64 bits raise an error. Columns besides id, label and
vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.llm.common import checkpoint
from shelfmark.llm.vectors import NO_ID, blocks, finite, matrix, meet, numbers, one_length

POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100
SCALE = 256
#: Rows of a block of candidates, and anchors that meet a block at a time.
ROWS, ANCHORS = 4_096, 1_024
#: Up to here whole numbers are exact as doubles.
_EXACT = 2**53


class SortedLists:
    """The rows of a block, and for each dimension their order."""

    def __init__(self, rows: np.ndarray):
        # Doubles multiply faster; they are taken where every product and sum is exact.
        largest = int(np.abs(rows).max(initial=0))
        self.rows = rows.astype(np.float64) if rows.shape[1] * largest * largest < _EXACT else rows
        self.order = np.ascontiguousarray(np.argsort(self.rows, axis=0, kind="stable").T, np.int32)
        self.values = np.ascontiguousarray(np.sort(self.rows, axis=0).T)

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Numbers and scores of the rows that come up, and the threshold for all others, depth after depth."""
        n = len(self.rows)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        rows, values = self.rows, self.values
        if rows.dtype == np.float64:
            if len(anchor) * float(np.abs(anchor).max(initial=0)) * float(np.abs(values).max(initial=0)) < _EXACT:
                anchor = anchor.astype(np.float64)
            else:
                rows, values = rows.astype(np.int64), values.astype(np.int64)
        seen = np.zeros(n, bool)
        depth = 32
        while depth < n and len(up) + len(down):
            fresh = np.zeros(n, bool)
            fresh[self.order[up, n - depth:]] = True
            fresh[self.order[down, :depth]] = True
            fresh &= ~seen
            seen |= fresh
            bound = anchor[up] @ values[up, n - depth] + anchor[down] @ values[down, depth - 1]
            at = np.flatnonzero(fresh)
            yield at, rows[at] @ anchor, bound
            depth *= 2
        at = np.flatnonzero(~seen)
        yield at, rows[at] @ anchor, -np.inf


def _first(score: np.ndarray, place: np.ndarray, tag: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the first k: by falling score, then id, then row."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= floor)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((tag[some], place[some], -score[some]))[:k]]


def _top(lists: SortedLists, anchor: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of rows that hold the first k of those in ``fits``, ties included."""
    at, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for more, points, bound in lists.read(anchor):
        good = fits[more]
        at, score = np.append(at, more[good]), np.append(score, points[good].astype(np.int64))
        if len(score) >= k:
            last = np.partition(score, len(score) - k)[len(score) - k]
            stay = score >= last
            at, score = at[stay], score[stay]
            if bound < last:
                break
    return at, score


def _windows(lists: SortedLists, anchor: np.ndarray, fits: np.ndarray, positives: list[int], k: int, low: int,
             high: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of rows in ``fits`` that hold the first k of each window, ties included."""
    at, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bottom = min(-(-low * p // 100) for p in positives)
    for more, points, bound in lists.read(anchor):
        points = points.astype(np.int64)
        good = fits[more] & (points >= bottom)
        at, score = np.append(at, more[good]), np.append(score, points[good])
        for p in positives:
            if 100 * bound < low * p:
                continue
            inside = score[(100 * score >= low * p) & (100 * score <= high * p)]
            if len(inside) < k or not bound < np.partition(inside, len(inside) - k)[len(inside) - k]:
                break
        else:
            break
    return at, score


def _listed(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.ListArray:
    cells = pa.StructArray.from_arrays(
        [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in range(len(names))], names)
    ends = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), cells)


def mine(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, id_column: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and ``negative_score``.

    Anchors are the rows where ``anchor`` holds. Higher scores come first, ties by smaller id.
    """
    base = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"),
                       numbers(F.col(vector)).alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    base = base.where(F.col("label").isNotNull() & finite(F.col("v")))
    base = base.select("label", "asks", F.coalesce("id", F.lit(NO_ID)).alias("place"), (F.col("id").isNotNull()).alias("named"),
                       F.transform("v", lambda x: F.floor(x * scale)).alias("c"),
                       F.array_max(F.transform("v", lambda x: F.abs(x * scale))).alias("size"),
                       F.monotonically_increasing_id().alias("tag"))
    base = one_length(checkpoint(base), "c")
    count, largest, length = base.agg(F.count("*"), F.max("size"), F.max(F.size("c"))).first()
    if count and max(100, low, high) * length * (largest + 1) ** 2 >= 2**63:
        raise ValueError("components are so large that a percentage of inner products may not fit into 64 bits")
    candidate_blocks = blocks(count, ROWS)
    anchor_blocks = blocks(base.where("asks AND named").count(), ANCHORS)
    side = base.select("tag", "place", "label", "c").withColumn(
        "block", F.pmod(F.xxhash64("tag", "place"), F.lit(candidate_blocks)).cast("int"))
    side = side.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    anchors = base.where("asks AND named").select("tag", "place", "label", "c")

    def dealt(asking: DataFrame) -> DataFrame:
        return asking.withColumn("part", F.pmod(F.xxhash64("tag"), F.lit(anchor_blocks)).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))))

    def same_label(block: pa.Table, asking: pa.Table) -> list:
        return _work(block, asking, None)

    def other_label(block: pa.Table, asking: pa.Table) -> list:
        return _work(block, asking, asking["scores"].to_pylist())

    def _work(block: pa.Table, asking: pa.Table, scores: list | None) -> list:
        lists = SortedLists(matrix(block["c"], np.int64))
        tag, place = block["tag"].to_numpy(), block["place"].to_numpy()
        label = np.array(block["label"].to_pylist())
        own, names = asking["tag"].to_numpy(), asking["label"].to_pylist()
        hits, owners = [], []
        for i, vector in enumerate(matrix(asking["c"], np.int64)):
            if scores is None:
                at, score = _top(lists, vector, (label == names[i]) & (tag != own[i]), positives)
                first = _first(score, place[at], tag[at], positives)
                at, score = at[first], score[first]
                hits.append((score, place[at], tag[at]))
                owners.append(i)
                continue
            wanted = list(dict.fromkeys(scores[i]))
            at, score = _windows(lists, vector, label != names[i], wanted, negatives, low, high)
            for p in wanted:
                inside = np.flatnonzero((100 * score >= low * p) & (100 * score <= high * p))
                inside = inside[_first(score[inside], place[at[inside]], tag[at[inside]], negatives)]
                if len(inside):
                    hits.append((score[inside], place[at[inside]], tag[at[inside]], np.full(len(inside), p)))
                    owners.append(i)
        width = ["score", "place", "tag", "positive_score"][:3 if scores is None else 4]
        if not hits:
            hits, owners = [tuple(np.zeros(0, np.int64) for _ in width)], [0]
        return [pa.array(own[owners]), _listed(hits, width)]

    cell = "score: bigint, place: bigint, tag: bigint"
    near = meet(side, dealt(anchors), ["block", "part"], same_label, f"anchor long, hits array<struct<{cell}>>")
    order = [F.desc("score"), F.col("place"), F.col("tag")]
    ranked = near.select("anchor", F.inline("hits")).withColumn(
        "n", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("n") <= positives)
    chosen = checkpoint(ranked.select("anchor", F.col("place").alias("positive"), F.col("n").alias("nth"), "score"))
    asking = anchors.join(chosen.groupBy(F.col("anchor").alias("tag")).agg(F.sort_array(F.collect_list("score")).alias("scores")),
                          "tag")
    hard = meet(side, dealt(asking), ["block", "part"], other_label,
                f"anchor long, hits array<struct<{cell}, positive_score: bigint>>")
    best = hard.select("anchor", F.inline("hits")).withColumn("rank", F.row_number().over(
        Window.partitionBy("anchor", "positive_score").orderBy(*order))).where(F.col("rank") <= negatives)
    # Positives of one anchor with equal scores have one window and share its rows.
    best = best.select(F.col("anchor").alias("a"), "positive_score", "rank", F.col("place").alias("negative"),
                       F.col("score").alias("negative_score"))
    named = chosen.join(best, (F.col("anchor") == F.col("a")) & (F.col("score") == F.col("positive_score")))
    named = named.join(anchors.select(F.col("tag").alias("t"), F.col("place").alias("anchor_id")), F.col("anchor") == F.col("t"))

    def shown(place: str) -> Column:
        return F.when(F.col(place) != NO_ID, F.col(place))

    return named.select("anchor_id", shown("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                        shown("negative").alias("negative_id"), "positive_score", "negative_score")
