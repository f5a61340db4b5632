import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import negatives, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, list string, gid int, tag string, place int, n int, block int"
EXTRA = ("own", 1, "own", 2, 3, 4)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_vectors():
    random = np.random.default_rng(5)
    rows = [(i, random.normal(size=6).astype("float32").tolist(), i % 3) for i in range(0, 300)]
    rows += [(300 + i, [1.0, 0.5, -0.25, 0.0, 2.0, 1.0], i % 2) for i in range(120)]  # equal vectors
    rows += [(500, [1.0] * 6, 1), (500, [1.0] * 6, 1), (600, [1.0] * 6, 2)]  # repeated rows and ties
    rows += [(700, None, 1), (720, [0.0] * 6, 1), (740, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (760, [float("nan")] * 6, 0),
             (780, [float("inf")] * 6, 0), (800, [1.0, 2.0], 0), (820, [], 1), (840, [3.0] * 6, None),
             (None, [2.0] * 6, 1), (-20, [-1.0] * 6, 2)]
    return rows


def taking_part(rows, zeros):
    out = []
    for i, v, label in rows:
        if v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and (zeros or any(v)):
            out.append((i, np.array(v, "float32").astype(float), label))
    return out


def brute_nearest(rows, k):
    rows = taking_part(rows, False)
    out = []
    for n, (i, v, _) in enumerate(rows):
        if i is not None and i % 20 == 0:
            hits = sorted((-float((v * w).sum()), j is None, j or 0, m) for m, (j, w, _) in enumerate(rows) if m != n)
            out += [(i, r + 1, None if none else j, round(-s, 9)) for r, (s, none, j, _) in enumerate(hits[:k])]
    return sorted(out, key=str)


def brute_negatives(rows, asks, k=5):
    rows = [(i, np.floor(256 * v).astype(np.int64), y) for i, v, y in taking_part(rows, True) if y is not None]
    out = []
    for n, (i, v, y) in enumerate(rows):
        if i is not None and asks(i):
            hits = sorted((-int(v @ w), j is None, j or 0, m, z) for m, (j, w, z) in enumerate(rows) if m != n)
            shown = lambda h: None if h[1] else h[2]
            for p in [h for h in hits if h[4] == y][:k]:
                fits = [h for h in hits if h[4] != y and 80 * -p[0] <= 100 * -h[0] <= 100 * -p[0]]
                out += [(i, shown(p), r + 1, shown(h), -p[0], -h[0]) for r, h in enumerate(fits[:k])]
    return sorted(out, key=str)


def test_nearest_equal_brute_force_when_all_lists_are_read(spark, odd_vectors):
    found = neighbours.nearest(table(spark, odd_vectors), F.col("vec_id") % 20 == 0)
    assert found.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:double>"
    assert sorted(((*r[:3], round(r[3], 9)) for r in found.collect()), key=str) == brute_nearest(odd_vectors, 20)


def test_few_rows_and_none(spark):
    rows = table(spark, [(0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (3, [0.0, 1.0], 2)])
    found = neighbours.nearest(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert neighbours.nearest(rows.where("vec_id > 5 AND vec_id < 2"), F.lit(True)).count() == 0
    assert neighbours.nearest(rows.where("vec_id = 0"), F.lit(True)).count() == 0
    assert negatives.mine(rows.where("vec_id < 0"), F.lit(True)).count() == 0
    assert negatives.mine(rows.where("vec_id = 0"), F.lit(True)).count() == 0


def test_recall_with_many_lists(spark):
    random = np.random.default_rng(3)
    base = random.normal(size=(40, 24))
    rows = [(i, (base[i % 40] + 0.6 * random.normal(size=24)).astype("float32").tolist(), 0) for i in range(6_000)]
    # A third of all rows close together, and an outlier in length.
    rows += [(10_000 + i, (base[0] * 2 + 0.05 * random.normal(size=24)).tolist(), 0) for i in range(3_000)]
    rows.append((40_000, (base[1] * 8).tolist(), 0))
    data = table(spark, rows).repartition(4)
    asks = F.col("vec_id") % 20 == 0
    found = neighbours.nearest(data, asks).cache()
    assert found.count() == 20 * sum(r[0] % 20 == 0 for r in rows)
    assert found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where("n <> 20").count() == 0
    assert found.where("query_id = vec_id").count() == 0
    assert neighbours.recall(data, found, asks) >= 0.9
    # Scores are products of the original vectors.
    vectors = {r[0]: np.array(r[1], "float32").astype(float) for r in rows}
    for r in found.limit(500).collect():
        assert abs((vectors[r.query_id] * vectors[r.vec_id]).sum() - r.score) < 1e-9


def test_lists_are_even_and_the_graph_finds_the_nearest():
    random = np.random.default_rng(1)
    points = random.normal(size=(4_000, 8))
    parts = neighbours.split_evenly(points, 32)
    assert len(parts) == 32 and {len(p) for p in parts} == {125}
    centroids = np.stack([points[p].mean(axis=0) for p in parts])
    lists = neighbours.Lists(centroids, neighbours.near_graph(centroids, 6), 1.0, 1.0)
    found = lists.search(points[:500], 1.1, 1)
    true = neighbours.distances(points[:500], centroids)
    assert (found.argmin(axis=1) == true.argmin(axis=1)).mean() > 0.99
    assert np.isin(np.flatnonzero(found[0] < np.inf), np.arange(32)).all()


def test_graph_joins_what_lies_apart():
    centroids = np.concatenate([np.eye(4)[[0] * 30] + np.arange(30)[:, None] * 1e-3, 100 + np.eye(4)[[1] * 30]])
    lists = neighbours.Lists(centroids, neighbours.near_graph(centroids, 3), 1.0, 1.0)
    assert (lists.search(centroids[:1], 1e9, 60) < np.inf).all()


def test_negatives_equal_brute_force(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    found = negatives.mine(table(spark, odd_vectors), F.col("vec_id") % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_negatives(odd_vectors, lambda i: i % 10 == 0)


def test_threshold_stops_before_the_end_and_misses_nothing():
    random = np.random.default_rng(2)
    rows = np.floor(256 * random.normal(size=(3_000, 3))).astype(np.int64)
    lists = negatives.SortedLists(rows)
    anchor = rows[7]
    read = 0
    best = -1
    for at, score, bound in lists.read(anchor):
        assert (score == rows[at] @ anchor).all()
        read += len(at)
        best = max(best, int(np.sort(score)[-5:].min()) if len(score) >= 5 else -1)
        if bound < best:
            break
    assert read < 3_000
    at, score = negatives._top(lists, anchor, np.ones(3_000, bool), 5)
    assert sorted(score)[-5:] == sorted(rows @ anchor)[-5:]


def test_large_components(spark):
    rows = [(i, [float(2**10 * (i + 1)), float(2**12 - i)], i // 50 % 2) for i in range(0, 300, 50)]
    found = negatives.mine(table(spark, rows), F.lit(True), low=0)
    vectors = {i: [int(x) * 256 for x in np.array(v, "float32")] for i, v, _ in rows}
    got = found.collect()
    assert got and all(r.negative_score == sum(a * b for a, b in zip(vectors[r.anchor_id], vectors[r.negative_id])) for r in got)
    with pytest.raises(ValueError):
        negatives.mine(table(spark, [(0, [1e30, 1.0], 0)]), F.lit(True))


def test_boundary_vectors_are_in_several_lists():
    centroids = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 2.0]])
    lists = neighbours.Lists(np.hstack([centroids, np.zeros((3, 1))]), neighbours.near_graph(centroids), 1.0, 10.0)
    lists.lift = lambda v: np.hstack([v, np.zeros((len(v), 1))])
    homes = lists.homes(np.array([[0.1, 0.0], [1.0, -0.2], [1.0, 0.75]]))
    assert [sorted(h.tolist()) for h in homes] == [[0], [0, 1], [0, 1, 2]]
