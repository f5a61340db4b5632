"""Sharding by best-fit-decreasing bin packing of groups that must stay together.

A group is all documents with one text; its size is the sum of theirs. Groups sorted by size enter the bin with the
tightest remaining capacity that still holds them, found in a balanced tree of capacities. With a number of shards
given instead of a capacity, the smallest capacity for which the packing needs no more shards is searched for, so
sizes come out nearly equal.

At scale the driver cannot see every group. Groups above a small share of a bin are few by arithmetic and are packed
one by one. The others are first gathered by hash into bundles, each also a small share of a bin, and a bundle is
packed as one item. Either kind is bounded by ``FINENESS`` items per bin, whatever the number of documents.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.llm.common import checkpoint

SHARDS = 24
HEADER_BYTES = 8
FINENESS = 1024
SPOTS = 512


class Node:
    __slots__ = ("key", "left", "priority", "right")

    def __init__(self, key: tuple, priority: float):
        self.key, self.priority = key, priority
        self.left: Node | None = None
        self.right: Node | None = None


class Treap:
    """A balanced search tree of keys: random priorities, drawn from a fixed seed, keep it balanced."""

    def __init__(self) -> None:
        self.root: Node | None = None
        self.random = random.Random(0)

    @classmethod
    def _split(cls, node: Node | None, key: tuple) -> tuple[Node | None, Node | None]:
        """Keys below ``key`` and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = cls._split(node.right, key)
            return node, high
        low, node.left = cls._split(node.left, key)
        return low, node

    @classmethod
    def _join(cls, low: Node | None, high: Node | None) -> Node | None:
        if low is None or high is None:
            return low or high
        if low.priority > high.priority:
            low.right = cls._join(low.right, high)
            return low
        high.left = cls._join(low, high.left)
        return high

    def add(self, key: tuple) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, Node(key, self.random.random())), high)

    def take(self, least: tuple) -> tuple | None:
        """Remove and return the smallest key that is at least ``least``."""
        low, high = self._split(self.root, least)
        if high is None:
            self.root = low
            return None
        parent, node = None, high
        while node.left is not None:
            parent, node = node, node.left
        if parent is None:
            high = node.right
        else:
            parent.left = node.right
        self.root = self._join(low, high)
        return node.key


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each item and the number of bins. ``sizes`` must fall. An item above the capacity has a bin to itself."""
    tree, bins, out = Treap(), 0, []
    for size in sizes:
        found = tree.take((size, -1))
        room, bin_ = found if found else (max(capacity, size), bins)
        bins += not found
        out.append(bin_)
        tree.add((room - size, bin_))
    return out, bins


def pack_evenly(sizes: Sequence[int], shards: int) -> list[int]:
    """Bins of falling ``sizes`` at the smallest capacity for which best-fit-decreasing needs at most ``shards`` bins.

    An item above its fair share has a bin to itself, and the others share the remaining bins evenly.
    """
    total, own = sum(sizes), 0
    while own < len(sizes) and own < shards - 1 and sizes[own] * (shards - own) > total:
        total -= sizes[own]
        own += 1
    if own:
        return [*range(own), *(own + b for b in pack_evenly(sizes[own:], shards - own))]
    largest = max(sizes, default=1)
    low = max(-(-total // shards), largest)
    best, bins = best_fit_decreasing(sizes, low)
    if bins <= shards:
        return best
    # A further bin is opened only if all are filled above the capacity less the item's size, so this always suffices.
    high = low + largest
    best, _ = best_fit_decreasing(sizes, high)
    while high - low > max(1, total // (shards * 4096)):
        middle = (low + high) // 2
        found, bins = best_fit_decreasing(sizes, middle)
        if bins <= shards:
            best, high = found, middle
        else:
            low = middle
    return best


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32`` and the hash ``group`` of each document; null and empty texts are one group.

    A group is known by two hashes of its text and its length: a chance meeting of two texts would only keep them
    together.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long")
    crc = F.crc32(text.cast("binary"))
    return docs.select("doc_id", (size + HEADER_BYTES).alias("size"), crc.alias("text_crc32"),
                       F.xxhash64(text, crc, size).alias("group"))


def assign(keys: DataFrame, capacity: int | None = None, shards: int | None = None) -> tuple[DataFrame, Column]:
    """The small table of packed items (``item``, ``shard``), and the item of a row of ``keys``.

    Its rows are at most ``FINENESS`` groups and as many bundles for each bin.
    """
    spark = keys.sparkSession
    groups = checkpoint(keys.groupBy("group").agg(F.sum("size").alias("size")))
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = shards if capacity is None else max(1, -(-total // capacity))
    large = max(1, total // (bins * FINENESS))
    bundle = F.pmod("group", F.lit(bins * FINENESS))
    # Large groups are items by their hash, bundles by a number in a space of their own.
    single = groups.where(F.col("size") >= large).select(F.lit(True).alias("single"), F.col("group").alias("item"), "size")
    rest = groups.where(F.col("size") < large).groupBy(bundle.alias("item")).agg(F.sum("size").alias("size")).select(
        F.lit(False).alias("single"), "item", "size")
    items = single.unionByName(rest).orderBy(F.desc("size"), "single", "item").collect()
    sizes = [r["size"] for r in items]
    bins_of = pack_evenly(sizes, shards) if capacity is None else best_fit_decreasing(sizes, capacity)[0]
    table = spark.createDataFrame(
        [(r["single"], r["item"], b) for r, b in zip(items, bins_of, strict=True)], "single boolean, item long, shard int")
    return table, bundle


def place(docs: DataFrame, capacity: int | None = None, shards: int | None = None) -> DataFrame:
    """Put every document into a shard: ``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` in the shard.

    Give a ``capacity`` in bytes for as few shards as the method finds, or a number of ``shards`` for sizes near equal.
    A null text has the size of its header alone. Slots count from 0 without gaps. Repeated rows have slots of their
    own. An empty table gives an empty result. A group above the capacity fills a shard by itself.
    """
    if (capacity is None) == (shards is None):
        raise ValueError("give either a capacity or a number of shards")
    keys = checkpoint(sized(docs))
    table, bundle = assign(keys, capacity, shards)
    singles = F.broadcast(table.where("single").select(F.col("item").alias("group"), F.col("shard").alias("own")))
    bundles = F.broadcast(table.where("NOT single").select("item", F.col("shard").alias("common")))
    placed = keys.join(singles, "group", "left").withColumn("item", bundle).join(bundles, "item", "left").select(
        "doc_id", "size", "text_crc32", F.coalesce("own", "common").alias("shard"))
    return number(placed)


def number(placed: DataFrame) -> DataFrame:
    """Add ``slot``: 0, 1, ... in each shard.

    A shard's rows are dealt over spots by a hash, each spot is numbered by itself, and the spots' counts, a bounded
    table, are summed up to where each begins. Equal rows are told apart by the task and place they stand at, which
    the checkpointed input fixes.
    """
    tagged = checkpoint(placed.withColumn("tag", F.monotonically_increasing_id()).withColumn(
        "spot", F.pmod(F.xxhash64("doc_id", "text_crc32", "tag"), F.lit(SPOTS))))
    counts = tagged.groupBy("shard", "spot").count()
    begins = counts.select("shard", "spot", (F.sum("count").over(
        Window.partitionBy("shard").orderBy("spot")) - F.col("count")).alias("begin"))
    within = F.row_number().over(Window.partitionBy("shard", "spot").orderBy("doc_id", "text_crc32", "tag")) - 1
    return tagged.withColumn("within", within).join(F.broadcast(begins), ["shard", "spot"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("within")).alias("slot"))
