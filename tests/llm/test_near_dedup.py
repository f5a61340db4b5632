import itertools
import random
import re

import numpy as np
from odd_rows import ODD
from pyspark.sql import functions as F

from shelfmark.llm import components, near_dedup, prefix_join


def union(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def whole_shingles(text):
    words = [w for w in re.split("[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+", (text or "").lower()) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(docs, similarity=0.8):
    sets = {i: whole_shingles(t) for i, t in docs}
    texts = {i: t or "" for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if texts[a] == texts[b] or (sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))]
    return union(sets, links)


def altered(words, share, rng):
    return " ".join(rng.choice("xyz") + str(rng.random()) if rng.random() < share else w for w in words)


def test_classes_against_brute_force(spark, small):
    rng = random.Random(4)
    docs = [(r.doc_id, r.text) for r in small.collect()]
    original = [f"w{rng.randrange(10_000)}" for _ in range(300)]
    docs += [(1000 + k, altered(original, 0.012, rng)) for k in range(60)]  # a large group of near copies
    docs += [(2000 + k, " ".join(original[:100]) + altered(original, 1, rng)) for k in range(30)]  # a shared passage
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = near_dedup.near_duplicates(df).collect()
    expected = brute_classes(docs)
    assert {r.doc_id: r.class_id for r in rows} == expected
    assert sorted(r.doc_id for r in rows if r.kept) == sorted(set(expected.values()))
    kept = near_dedup.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(expected.values()))


def test_odd_rows(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    left = kept.collect()
    assert len(left) == sum(r.kept for r in rows) == len({t or "" for _, t in ODD})
    assert sorted(r.text or "" for r in left) == sorted({t or "" for _, t in ODD})
    assert {r.class_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.keep_one(none).count() == 0


def test_sketch_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(1, 2**62, 400).astype(np.uint64))
    a = (base[:300], rng.integers(1, 5, 300).astype(float))
    b = (base[100:], rng.integers(1, 5, len(base) - 100).astype(float))
    wa, wb = dict(zip(a[0].tolist(), a[1], strict=True)), dict(zip(b[0].tolist(), b[1], strict=True))
    exact = sum(
        1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in wa.keys() | wb.keys()) for d in wa.keys() & wb.keys())
    got = near_dedup.sketches([a, b], 4096)
    assert abs((got[0] == got[1]).mean() - exact) < 0.03
    # Points do not depend on what a set is sketched together with.
    assert (near_dedup.sketches([a], 64)[0] == near_dedup.sketches([b, a, b], 64)[1]).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + k, 501 + k) for k in range(40)] + [(900, k) for k in range(901, 960)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = union({n for p in links if p[0] != p[1] for n in p}, links)
    assert {r.node: r.root for r in found} == expected and len(found) == len(expected)
    assert components.components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0


def changed(words, spots, rng):
    out = list(words)
    for at in rng.sample(range(10, len(words) - 10), spots):
        out[at] = f"x{rng.random()}"
    return out


def test_members_of_a_large_group_whose_only_link_is_to_no_leader(spark):
    rng = random.Random(8)
    template = [f"w{rng.randrange(10_000)}" for _ in range(300)]
    docs = []
    for k in range(200):  # members are 0.76 alike, each has one partner at 0.8
        member = changed(template, 4, rng)
        docs += [(k, " ".join(member)), (1000 + k, " ".join(changed(member, 6, rng)))]
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(docs)


def test_copies_that_repeat_a_passage_more_often(spark):
    rng = random.Random(9)
    docs = []
    for k in range(60):
        passage = " ".join(f"p{k}x{j}" for j in range(24))
        shared = " ".join(f"s{k}x{j}" for j in range(84))
        for copy, times in enumerate((1, 50)):
            docs.append((1000 * copy + k, " ".join([passage] * times + [shared] + [f"o{rng.random()}" for _ in range(3)])))
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(docs)


def test_filters_keep_every_pair(spark, monkeypatch):
    """Whatever the packs and ranges, all pairs of different classes that are alike come out."""
    monkeypatch.setattr(prefix_join, "PACK_SETS", 7)
    monkeypatch.setattr(prefix_join, "RANGE_TOKENS", 64)
    rng = np.random.default_rng(6)
    base = rng.integers(-2**31, 2**31, 400)
    sets = []
    for _ in range(150):
        size = int(rng.integers(3, 40))
        own = set(base[rng.integers(0, 8) * 40:][:size].tolist())
        own |= {int(base[rng.integers(0, 400)]) for _ in range(rng.integers(0, 4))}
        sets.append(sorted(own))
    roots = [int(rng.integers(0, 60)) for _ in sets]
    rows = spark.createDataFrame([(i, roots[i], len(s), s) for i, s in enumerate(sets)],
                                 "gid long, root long, n int, tokens array<int>").repartition(3)
    alike = {(i, j) for i in range(150) for j in range(150)
             if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    across = {frozenset(p) for p in alike if roots[p[0]] != roots[p[1]]}
    found = {frozenset(r) for r in prefix_join.pairs_across(rows, 0.8).collect()}
    assert across and across <= found and len(found) < 3 * len(across)
    singles = rows.withColumn("root", F.col("gid"))
    kept = {r.gid for r in prefix_join.covered(singles, 0.8).collect()}
    assert {i for i, j in alike if i != j} <= kept
    assert {r.gid for r in prefix_join.covered(rows, 0.8).collect()} >= {i for p in across for i in p}


def test_first_part_has_the_need_inside():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 5, 17, 100):
        found = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        part = prefix_join.first_part(found, 0.8, 0.1)
        assert len(part) == min(n, n - int(np.ceil(0.8 * n - 1e-6)) + 1 + int(0.1 * n))
        assert set(part.tolist()) <= set((found >> np.uint64(32)).tolist())
