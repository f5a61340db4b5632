import random
import zlib
from collections import defaultdict

from odd_rows import ODD

from shelfmark.llm import sharding


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for size in sizes:
        fits = sorted((room, b) for b, room in enumerate(rooms) if room >= size)
        if fits:
            b = fits[0][1]
        else:
            b = len(rooms)
            rooms.append(max(capacity, size))
        rooms[b] -= size
        out.append(b)
    return out, len(rooms)


def test_tree_packs_like_a_plain_search():
    rng = random.Random(5)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 50) for _ in range(rng.randint(0, 80))), reverse=True)
        assert sharding.best_fit_decreasing(sizes, 60) == plain_best_fit(sizes, 60)


def test_even_packing():
    rng = random.Random(6)
    sizes = sorted((rng.randint(1, 50) for _ in range(3000)), reverse=True)
    totals = defaultdict(int)
    for size, b in zip(sizes, sharding.pack_evenly(sizes, 24), strict=True):
        totals[b] += size
    assert len(totals) == 24 and max(totals.values()) - min(totals.values()) < 60
    assert sharding.pack_evenly([900, 10, 10, 10, 10], 3) == [0, 1, 2, 1, 2] or len(set(sharding.pack_evenly([900, 10, 10, 10, 10], 3))) == 3


def check(rows, texts):
    assert len(rows) == len(texts)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        groups[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)


def test_odd_rows(odd, none):
    check(sharding.place(odd, shards=5).collect(), [t for _, t in ODD])
    check(sharding.place(odd, capacity=200_000).collect(), [t for _, t in ODD])
    assert sharding.place(none, shards=5).count() == 0


def test_shards_of_a_table_are_even(small):
    rows = sharding.place(small, shards=24).collect()
    check(rows, [r.text for r in small.collect()])
    totals = defaultdict(int)
    for r in rows:
        totals[r.shard] += r.size
    assert len(totals) == 24 and max(totals.values()) - min(totals.values()) <= max(r.size for r in rows)
