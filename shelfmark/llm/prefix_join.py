"""Which sets may be alike: two filters that miss no pair.

Coverage. Two sets with a Jaccard similarity of t or more share at least t x elements of either size x. So a set counts
only if that many of its elements are in other sets too (or in sets of other classes, where classes are known). If just a
part of a set's elements is looked at, what is left out may all be shared: the need falls by its size.

How common an element is, is counted exactly over all sets: each task gathers its sets into packs and sends every distinct
element of a pack once, by ranges of elements; a range adds up and sends its numbers back to the packs, in order. So an
element that a third of all sets has is a few numbers from each pack, not a group of rows.

Positions. Elements are put in one order, rare ones first. Sets that share o elements share one among the first
x - o + 1 of either set. With o for two sets of equal size, the shorter (or equal) set needs few of its first elements
(index), the other a few more (probe); an element that one class alone has takes a place in this order and meets nobody.
Sizes and positions rule out a meeting within the join already, so only pairs come out that can still reach t.

Elements are written with 32 bits; two that fall together can only add pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import checkpoint, list_array, map_columns, written
from shelfmark.llm.vectors import blocks, meet

#: Sets and elements of a pack, elements of a range, fewest ranges.
PACK_SETS, PACK_TOKENS = 5_000, 1 << 21
RANGE_TOKENS, LEAST_RANGES = 1 << 19, 16
_SLACK = 1e-6
_PACK = "pack long, gids binary, roots binary, sizes binary, ends binary, tokens binary"


def needed(n: np.ndarray, similarity: float) -> np.ndarray:
    """Elements that a set of ``n`` shares at least with one that is alike."""
    return np.ceil(similarity * n - _SLACK).astype(np.int64)


def first_part(found: np.ndarray, similarity: float, more: float) -> np.ndarray:
    """Of a set of 64-bit hashes those that are smallest: so many that a share of ``more`` has to be shared among them."""
    n = len(found)
    size = min(n, n - math.ceil(similarity * n - _SLACK) + 1 + int(more * n))
    small = np.partition(found, size - 1)[:size] if 0 < size < n else found
    return (small >> np.uint64(32)).astype(np.uint32)


def packs(sets: DataFrame) -> DataFrame:
    """Sets (``gid``, ``root``, ``n``, ``tokens``) gathered into packs of bounded size, as a stored table."""

    def work(batches: Iterator[list[pa.Array]]) -> Iterator[tuple]:
        made = TaskContext.get().partitionId() << 33
        for gid, root, n, tokens in batches:
            ends = tokens.offsets.to_numpy().astype(np.int64)
            flat = tokens.values.to_numpy()
            low = 0
            while low < len(gid):
                high = low + 1
                while high < len(gid) and high - low < PACK_SETS and ends[high + 1] - ends[low] <= PACK_TOKENS:
                    high += 1
                yield ([made], *([x.to_numpy()[low:high].tobytes()] for x in (gid, root, n)),
                       [(ends[low + 1:high + 1] - ends[low]).tobytes()], [flat[ends[low]:ends[high]].tobytes()])
                made += 1
                low = high

    return written(map_columns(sets.select("gid", "root", F.col("n").cast("int"), "tokens"), work, _PACK))


class Pack:
    """One pack's arrays, and its distinct elements in order."""

    def __init__(self, pack: int, gids: bytes, roots: bytes, sizes: bytes, ends: bytes, tokens: bytes):
        self.pack = pack
        self.gids, self.roots = np.frombuffer(gids, np.int64), np.frombuffer(roots, np.int64)
        self.sizes, self.ends = np.frombuffer(sizes, np.int32), np.frombuffer(ends, np.int64)
        self.tokens = np.frombuffer(tokens, np.uint32)
        self.owner = np.repeat(np.arange(len(self.gids)), np.diff(self.ends, prepend=0))
        self.distinct, self.place = np.unique(self.tokens, return_inverse=True)

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct element how many classes of the pack have it (up to 65,535), and the smallest of these."""
        root = self.roots[self.owner]
        order = np.lexsort((root, self.place))
        place, root = self.place[order], root[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        new = first.copy()
        new[1:] |= root[1:] != root[:-1]
        return np.minimum(np.bincount(place[new], minlength=len(self.distinct)), 65_535).astype(np.uint16), root[first]


def _ranks(packed: DataFrame, ranges: int) -> DataFrame:
    """``pack``, ``range`` and, for its distinct elements in that range in order, ``ranks``: 0 if one class alone has the
    element, else how many have it, a class counted once in each pack (up to 65,535)."""

    def parts(batches: Iterator[list[pa.Array]]) -> Iterator[tuple]:
        for columns in batches:
            for row in zip(*(c.to_pylist() for c in columns), strict=True):
                pack = Pack(*row)
                many, root = pack.classes()
                edges = (np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges)
                cuts = np.searchsorted(pack.distinct.astype(np.uint64), edges)
                spans = [(r, a, b) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
                yield ([pack.pack] * len(spans), [r for r, _, _ in spans],
                       *([x[a:b].tobytes() for _, a, b in spans] for x in (pack.distinct, many, root)))

    cells = map_columns(packed.select("pack", "gids", "roots", "sizes", "ends", "tokens"), parts,
                        "pack long, range int, tokens binary, many binary, roots binary")

    def count(table: pa.Table) -> pa.Table:
        tokens, many, roots = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (
            ("tokens", np.uint32), ("many", np.uint16), ("roots", np.int64)))
        distinct, place = np.unique(tokens, return_inverse=True)
        total = np.bincount(place, many.astype(np.int64), len(distinct)).astype(np.int64)
        low, high = np.full(len(distinct), 2**63 - 1), np.full(len(distinct), -2**63)
        np.minimum.at(low, place, roots)
        np.maximum.at(high, place, roots)
        several = np.bincount(place, many > 1, len(distinct)) > 0
        rank = np.where((low < high) | several, np.minimum(total, 65_535), 0).astype(np.uint16)[place].tobytes()
        ends = 2 * np.cumsum([len(t) // 4 for t in table["tokens"].to_pylist()])
        return pa.table({"pack": table["pack"], "range": table["range"],
                         "ranks": pa.array([rank[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())})

    return cells.groupBy("range").applyInArrow(count, "pack long, range int, ranks binary")


def _ranked(packed: DataFrame, found, schema: str) -> DataFrame:
    """``found(pack, rank of each of its elements)`` for every pack, as columns of ``schema``."""
    size = packed.agg(F.sum(F.length("tokens"))).first()[0] or 0
    ranks = _ranks(packed, max(LEAST_RANGES, blocks(size // 4, RANGE_TOKENS)))

    def work(table: pa.Table, ranks: pa.Table) -> list:
        pack = Pack(*(table[c][0].as_py() for c in ("pack", "gids", "roots", "sizes", "ends", "tokens")))
        by_range = sorted(zip(ranks["range"].to_pylist(), ranks["ranks"].to_pylist(), strict=True))
        return found(pack, np.frombuffer(b"".join(r for _, r in by_range), np.uint16)[pack.place])

    return meet(packed, ranks, ["pack"], work, schema)


def covered(sets: DataFrame, similarity: float) -> DataFrame:
    """``gid`` of the sets that may be alike to another one.

    ``gid``, ``root`` (class, or the set itself), ``n`` (its size) and ``tokens`` (its elements, or some of them).
    """

    def found(pack: Pack, rank: np.ndarray) -> list:
        held = np.diff(pack.ends, prepend=0)
        shared = np.bincount(pack.owner, rank > 0, len(pack.gids))
        return [pack.gids[shared >= needed(pack.sizes, similarity) - (pack.sizes - held)]]

    return _ranked(packs(sets), found, "gid long")


def postings(sets: DataFrame, similarity: float) -> DataFrame:
    """``gid``, ``root``, ``n``, ``spots`` (element and position) of whole sets that may be alike to one of another class."""

    def found(pack: Pack, rank: np.ndarray) -> list:
        shared = np.bincount(pack.owner, rank > 0, len(pack.gids))
        stays = shared >= needed(pack.sizes, similarity)
        order = np.lexsort((pack.tokens, rank, pack.owner))
        starts = pack.ends - np.diff(pack.ends, prepend=0)
        owner, rank = pack.owner[order], rank[order]
        position = np.arange(len(order)) - starts[owner]
        probe = pack.sizes - needed(pack.sizes, similarity) + 1
        use = stays[owner] & (rank > 0) & (position < probe[owner])
        many = np.bincount(owner[use], minlength=len(pack.gids))[stays]
        ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        cells = pa.StructArray.from_arrays(
            [pa.array(pack.tokens[order][use].view(np.int32)), pa.array(position[use].astype(np.int32))], ["token", "at"])
        return [pack.gids[stays], pack.roots[stays], pack.sizes[stays], pa.ListArray.from_arrays(pa.array(ends), cells)]

    return _ranked(packs(sets), found, "gid long, root long, n int, spots array<struct<token: int, at: int>>")


def pairs_across(sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``a``, ``b`` of different classes that may be alike, from ``gid``, ``root``, ``n`` and whole ``tokens``."""
    spots = checkpoint(postings(sets, similarity).select("gid", "root", "n", F.inline("spots")))
    both = similarity / (1 + similarity)
    index = F.col("at") <= F.col("n") - F.ceil(2 * both * F.col("n") - _SLACK)
    a = spots.select("token", *[F.col(c).alias(f"{c}_a") for c in ("gid", "root", "n", "at")])
    b = spots.where(index).select("token", *[F.col(c).alias(f"{c}_b") for c in ("gid", "root", "n", "at")])
    shared = F.ceil(both * (F.col("n_a") + F.col("n_b")) - _SLACK)

    def early(side: str) -> Column:
        return F.col(f"at_{side}") <= F.col(f"n_{side}") - shared

    longer = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("gid_a") > F.col("gid_b")))
    met = a.join(b, (a["token"] == b["token"]) & (F.col("root_a") != F.col("root_b")) & longer
                 & (F.col("n_b") >= similarity * F.col("n_a") - _SLACK) & early("a") & early("b"))
    return met.select(F.col("gid_a").alias("a"), F.col("gid_b").alias("b")).distinct()
