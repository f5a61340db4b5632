"""Approximate nearest neighbours by balanced posting lists.

Nearness is the inner product. One more component, the square root of the largest squared length less the own one, makes
all vectors equally long, so that the largest product is the smallest distance.

Fit. A sample of bounded size is halved again and again, each time between two centres at the median, so that every list
gets an equal share of the sample. The lists' centroids are linked to a graph of near neighbours; it is searched in
memory, from a few entries, wave by wave. Both are bounded (``MOST_LISTS``), however many vectors there are.

Index. Every vector goes to its nearest list, and boundary vectors to more: to lists not much farther than the nearest one
(``BOUNDARY``, at most ``REPLICAS``).

Search. A query reads the lists whose centroid is at most ``ratio`` times as far as its nearest centroid, at least
``LEAST_LISTS``, and more until they hold enough vectors. The ratio is measured on the sample: the one at which ``TARGET``
of the true neighbours of sample queries are in lists that would be read. All rows are denser than the sample, their
neighbours nearer, so recall over all rows is no less as a rule; :func:`recall` measures it.

Work. Equal vectors are searched once, and of a group of equal vectors as many rows as an answer holds are stored in the
lists (those with the smallest ids): the rest cannot be in any answer. Lists and their queries are cut into blocks of
bounded size, so that a long list or one asked by very many queries is the work of many tasks.

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do those of another length
than most. A null id is no query; it can be found, after others in ties. Repeated rows are rows of their own; a query
never finds its own row. An empty table gives no rows. Columns besides id and vector are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.llm.common import checkpoint, hash_sample, let, list_array, map_columns, written
from shelfmark.llm.vectors import NO_ID, blocks, finite, matrix, meet, numbers, one_length

K = 20
#: Vectors that the lists are fitted on; vectors of a list that are aimed at; most lists.
SAMPLE, LIST_ROWS, MOST_LISTS = 20_000, 512, 8_192
#: How much farther than the nearest list another may be to get a copy, and most lists of one vector.
BOUNDARY, REPLICAS = 1.01, 3
LEAST_LISTS, TARGET = 4, 0.95
#: Neighbours of a centroid in the graph, entries and shortest queue of a search.
DEGREE, ENTRIES, QUEUE = 24, 16, 24
#: Vectors and queries that meet in one piece of work.
CHUNK, BLOCK = 2_048, 2_048
ASKED = 256


def split_evenly(points: np.ndarray, parts: int, seed: int = 0) -> list[np.ndarray]:
    """Numbers of the points of each part; parts have equal shares, near points stay together."""
    random = np.random.default_rng(seed)
    todo, done = [(np.arange(len(points)), parts)], []
    while todo:
        members, n = todo.pop()
        if n <= 1 or len(members) < 2:
            done.append(members)
            continue
        own = points[members]
        centres = own[random.choice(len(own), 2, replace=False)]
        share = len(own) * (n // 2) // n
        for _ in range(8):
            lean = own @ (centres[0] - centres[1])
            order = np.argsort(-lean, kind="stable")
            centres = np.stack([own[order[:share]].mean(axis=0), own[order[share:]].mean(axis=0)])
        todo += [(members[order[:share]], n // 2), (members[order[share:]], n - n // 2)]
    return [m for m in done if len(m)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def near_graph(centroids: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Neighbours of each centroid: the nearest ones, both ways, and links that join what would fall apart."""
    n = len(centroids)
    near: list[set[int]] = [set() for _ in range(n)]
    for low in range(0, n, 1024):
        d = distances(centroids[low:low + 1024], centroids)
        d[np.arange(len(d)), np.arange(low, low + len(d))] = np.inf
        for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, :min(degree, n - 1)].tolist(), low):
            near[i].update(row)
            for j in row:
                near[j].add(i)
    part = np.full(n, -1)
    parts = 0
    for start in range(n):
        if part[start] < 0:
            part[start], todo = parts, [start]
            while todo:
                for j in near[todo.pop()]:
                    if part[j] < 0:
                        part[j] = parts
                        todo.append(j)
            parts += 1
    for p in range(1, parts):
        mine, before = np.flatnonzero(part == p), np.flatnonzero(part < p)
        i, j = np.unravel_index(distances(centroids[mine[:256]], centroids[before]).argmin(), (len(mine[:256]), len(before)))
        near[mine[i]].add(int(before[j]))
        near[before[j]].add(int(mine[i]))
    return [np.array(sorted(s), np.int64) for s in near]


@dataclass
class Lists:
    """Centroids, their graph and what a search needs to know; of bounded size."""

    centroids: np.ndarray
    graph: list[np.ndarray]
    scale: float
    longest: float
    ratio: float = math.inf

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors that are searched for, with the component that makes them equally long."""
        own = vectors / self.scale
        rest = self.longest**2 - (own * own).sum(axis=1)
        return np.hstack([own, np.sqrt(np.maximum(rest, 0))[:, None]])

    def aim(self, vectors: np.ndarray) -> np.ndarray:
        """Queries: of the common length, without a share in the added component."""
        own = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        own *= self.longest / np.sqrt((own * own).sum(axis=1, keepdims=True))
        return np.hstack([own, np.zeros((len(own), 1))])

    def __post_init__(self) -> None:
        self.squares = (self.centroids * self.centroids).sum(axis=1)
        n = len(self.centroids)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64)) if n else np.zeros(0, np.int64)
        self.degree = np.array([len(g) for g in self.graph], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.degree)])
        self.ends = np.concatenate(self.graph) if n else np.zeros(0, np.int64)

    def search(self, points: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances of each point to the lists the graph search has met (else infinite).

        In each wave every point looks at the neighbours of all its lists not looked at yet that are among its ``QUEUE``
        (or ``least``) nearest or within ``ratio`` of the nearest.
        """
        n, size = len(points), len(self.centroids)
        found = np.full((n, size), np.inf)
        looked = np.zeros((n, size), bool)
        own = (points * points).sum(axis=1)
        who = np.repeat(np.arange(n), len(self.entries))
        where = np.tile(self.entries, n)
        queue = min(size, max(QUEUE, least))
        while len(who):
            square = own[who] + self.squares[where] - 2 * np.einsum("ij,ij->i", points[who], self.centroids[where])
            found[who, where] = np.sqrt(np.maximum(square, 0))
            reach = np.maximum(np.partition(found, queue - 1, axis=1)[:, queue - 1], ratio * found.min(axis=1))
            who, where = np.nonzero((found <= reach[:, None]) & (found < np.inf) & ~looked)
            looked[who, where] = True
            many = self.degree[where]
            who = np.repeat(who, many)
            spots = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[where], many)
            new = np.unique(who * size + self.ends[spots]) if len(who) else np.zeros(0, np.int64)
            who, where = new // size, new % size
            fresh = found[who, where] == np.inf
            who, where = who[fresh], where[fresh]
        return found

    def homes(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Lists of each vector, the nearest first."""
        out = []
        for low in range(0, len(vectors), 256):
            found = self.search(self.lift(vectors[low:low + 256]), BOUNDARY, 1)
            near = np.argsort(found, axis=1, kind="stable")[:, :REPLICAS]
            for row, picks in zip(found, near, strict=True):
                chosen = picks[row[picks] <= BOUNDARY * row[picks[0]]]
                out.append(chosen)
        return out

    def reads(self, vectors: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
        """Lists that each query reads. ``rows``: how many rows have their nearest list there."""
        out = []
        for low in range(0, len(vectors), 256):
            points = self.aim(vectors[low:low + 256])
            found = self.search(points, self.ratio, LEAST_LISTS)
            order = np.argsort(found, axis=1, kind="stable")
            for i, (row, near) in enumerate(zip(found, order, strict=True)):
                chosen = near[:max(int((row <= self.ratio * row[near[0]]).sum()), min(LEAST_LISTS, len(near)))]
                chosen = chosen[row[chosen] < np.inf]
                if rows[chosen].sum() <= k:
                    far = np.argsort(distances(points[i:i + 1], self.centroids)[0], kind="stable")
                    chosen = far[:int(np.searchsorted(np.cumsum(rows[far]), k + 1)) + 1]
                out.append(chosen)
        return out


def fit(vectors: DataFrame, k: int = K, sample: int = SAMPLE, list_rows: int = LIST_ROWS) -> Lists | None:
    """Lists for ``vectors`` (``gid``, ``v``), fitted on ``sample`` of them by hash; None if there are none."""
    count, scale = vectors.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not count:
        return None
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale))
    longest = math.sqrt(vectors.agg(F.max(squares)).first()[0])
    picked = matrix(hash_sample(vectors, sample, "gid").select("v").toArrow()["v"])
    lists = Lists(np.zeros((0, picked.shape[1] + 1)), [], scale, longest)
    lifted = lists.lift(picked)
    parts = split_evenly(lifted, min(MOST_LISTS, blocks(count, list_rows), blocks(len(picked), 8)))
    centroids = np.unique(np.stack([lifted[p].mean(axis=0) for p in parts]), axis=0)
    lists = Lists(centroids, near_graph(centroids), scale, longest)
    lists.ratio = _ratio(lists, picked, k)
    return lists


def _ratio(lists: Lists, sample: np.ndarray, k: int) -> float:
    """The smallest ratio at which ``TARGET`` of the nearest neighbours within the sample are read."""
    asked = sample[:: max(1, len(sample) // ASKED)][:ASKED]
    score = asked @ sample.T
    near = np.argsort(-score, axis=1, kind="stable")[:, :k + 1]
    homes = dict(zip(u := np.unique(near), lists.homes(sample[u]), strict=True))
    far = distances(lists.aim(asked), lists.centroids)
    far /= np.maximum(far.min(axis=1, keepdims=True), 1e-12)
    needed = np.sort(np.array([far[i, homes[j]].min() for i, row in enumerate(near) for j in row.tolist()]))
    return float(needed[min(len(needed) - 1, math.ceil(TARGET * len(needed)))]) * (1 + 1e-9)


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products of pairs, multiplied one by one: equal whatever the vectors around, so ties are ties."""
    return (queries * vectors).sum(axis=-1)


def _top(queries: np.ndarray, x: np.ndarray, many: np.ndarray, place: np.ndarray, tag: np.ndarray, k: int) -> list[tuple]:
    """The first k rows for each query: score with the sign changed, id, row. ``many``: rows of each vector."""
    ends = np.concatenate([[0], np.cumsum(many)])
    out: list[tuple] = []
    for low in range(0, len(queries), 128):
        q = queries[low:low + 128]
        score = q @ x.T
        spare = min(len(x), k + 4)
        near = np.argpartition(-score, spare - 1, axis=1)[:, :spare]
        kth = np.partition(np.take_along_axis(score, near, axis=1), max(0, spare - k), axis=1)[:, max(0, spare - k)]
        # What rounding may have put below the k-th has to be among those looked at.
        floor = kth - 1e-9 * np.maximum(1.0, np.abs(kth))
        simple = (score >= floor[:, None]).sum(axis=1) <= spare if spare < len(x) else np.ones(len(q), bool)
        minus = -_exact(q[:, None, :], x[near])
        for i, ok in enumerate(simple.tolist()):
            at, own = (near[i], minus[i]) if ok else (f := np.flatnonzero(score[i] >= floor[i]), -_exact(q[i], x[f]))
            if len(place) > len(x):
                spots = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in at.tolist()])
                own = np.repeat(own, many[at])
            else:
                spots = at
            first = np.lexsort((tag[spots], place[spots], own))[:k]
            out.append((own[first], place[spots[first]], tag[spots[first]]))
    return out


def _taking_part(rows: DataFrame, query: Column, id_column: str, vector: str) -> DataFrame:
    """``gid`` (names a vector), ``v``, ``id``, ``place`` (id, nulls last), ``tag`` (names a row), ``asks``."""
    base = rows.select(F.col(id_column).cast("long").alias("id"), numbers(F.col(vector)).alias("v"),
                       F.coalesce(query, F.lit(False)).alias("asks"))
    base = base.where(finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    base = base.withColumn("tag", F.monotonically_increasing_id()).withColumn("place", F.coalesce("id", F.lit(NO_ID)))
    gid = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), "v").alias("b"))
    return one_length(checkpoint(base.withColumn("gid", gid)), "v")


def nearest(
    rows: DataFrame, query: Column, k: int = K, id_column: str = "vec_id", vector: str = "embedding", lists: Lists | None = None,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (inner product, double) of each query row's ``k`` nearest.

    Queries are the rows where ``query`` holds and the id is not null, candidates all rows but the query's own. Nearest
    first, ties to the smaller id; all candidates if there are no more than ``k``.
    """
    base = _taking_part(rows, query & F.col(id_column).isNotNull(), id_column, vector)
    order = Window.partitionBy("gid").orderBy("place", "tag")
    stored = base.select("gid", "v", "place", "tag", F.row_number().over(order).alias("n")).where(F.col("n") <= k + 1)
    vectors = checkpoint(stored.groupBy("gid").agg(
        F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("place", "tag"))).alias("rows")))
    lists = lists or fit(vectors, k)
    if lists is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def homes(v: pa.ListArray) -> tuple:
        return (list_array(lists.homes(matrix(v)) if len(v) else [], pa.int64()),)

    posted = written(map_columns(vectors.select("gid", "rows", "v"), lambda b: ((g, r, v, *homes(v)) for g, r, v in b),
                                 f"gid {vectors.schema['gid'].dataType.simpleString()}, "
                                 f"rows {vectors.schema['rows'].dataType.simpleString()}, v array<double>, lists array<long>"))
    counted = posted.groupBy(F.col("lists")[0].alias("list")).agg(F.sum(F.size("rows")).alias("n")).collect()
    primary = np.zeros(len(lists.centroids), np.int64)
    for r in counted:
        primary[r["list"]] = r["n"]
    asked = base.where("asks").groupBy("gid").agg(F.first("v").alias("v"))

    def reads(v: pa.ListArray) -> tuple:
        return (list_array(lists.reads(matrix(v), primary, k) if len(v) else [], pa.int64()),)

    probes = written(map_columns(asked.select("gid", "v"), lambda b: ((g, v, *reads(v)) for g, v in b),
                                 f"gid {vectors.schema['gid'].dataType.simpleString()}, v array<double>, lists array<long>"))
    found = _meetings(posted, probes, k)
    salted = found.groupBy("gid", F.pmod(F.xxhash64("unit"), F.lit(32)).alias("s")).agg(F.collect_list("hits").alias("lists"))
    best = salted.select("gid", _merged("lists", k)).groupBy("gid").agg(F.collect_list("hits").alias("lists")).select(
        "gid", _merged("lists", k))
    answer = base.where("asks").select("gid", "id", "tag").join(best, "gid")
    others = F.slice(F.filter("hits", lambda h: h["tag"] != F.col("tag")), 1, k)
    return answer.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"),
        F.when(F.col("hit.place") != NO_ID, F.col("hit.place")).alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def _merged(lists: str, k: int) -> Column:
    """The first k + 1 hits of several lists; a row that was met in two lists counts once."""
    ordered = let(F.sort_array(F.flatten(lists)), lambda hits: F.filter(
        hits, lambda h, i: (i == 0) | (h["tag"] != F.coalesce(F.get(hits, i - 1)["tag"], F.lit(-1)))))
    return F.slice(ordered, 1, k + 1).alias("hits")


def _meetings(posted: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """``gid`` of a query, the ``unit`` of work, and its best ``hits`` there (score with the sign changed, id, row)."""
    stored = posted.select("gid", "rows", "v", F.explode("lists").alias("list"))
    asked = probes.select("gid", "v", F.explode("lists").alias("list"))
    # One row for each list, of which there are MOST_LISTS at most.
    cuts = F.broadcast(checkpoint(stored.groupBy("list").agg(F.count("*").alias("n")).join(
        asked.groupBy("list").agg(F.count("*").alias("m")), "list").select(
            "list", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        return side.join(cuts, "list").withColumn(own[:-1], F.pmod(F.hash("gid"), F.col(own))).withColumn(
            other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("chunks", "blocks")

    def work(vectors: pa.Table, queries: pa.Table) -> list:
        x, q = matrix(vectors["v"]), matrix(queries["v"])
        members = vectors["rows"].combine_chunks()
        flat = members.flatten()
        many = np.diff(members.offsets.to_numpy())
        out = _top(q, x, many, flat.field("place").to_numpy(), flat.field("tag").to_numpy(), k + 1)
        cells = pa.StructArray.from_arrays(
            [pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["minus", "place", "tag"])
        offsets = np.concatenate([[0], np.cumsum([len(o[0]) for o in out])]).astype(np.int32)
        unit = (vectors["list"][0].as_py() << 24) + (vectors["chunk"][0].as_py() << 8) + vectors["block"][0].as_py()
        return [queries["gid"].combine_chunks(), pa.array(np.full(len(q), unit)),
                pa.ListArray.from_arrays(pa.array(offsets), cells)]

    gid = posted.schema["gid"].dataType.simpleString()
    return meet(dealt(stored, "chunks", "blocks"), dealt(asked, "blocks", "chunks"), ["list", "chunk", "block"], work,
                f"gid {gid}, unit long, hits array<struct<minus: double, place: bigint, tag: bigint>>")


def recall(
    rows: DataFrame, found: DataFrame, query: Column, k: int = K, sample: int = 200, id_column: str = "vec_id",
    vector: str = "embedding",
) -> float:
    """Share of true neighbours that ``found`` has, over at most ``sample`` queries compared with every row (by score).

    A found row counts if its score is at least the true k-th score, so that ties are no misses.
    """
    base = _taking_part(rows, query & F.col(id_column).isNotNull(), id_column, vector)
    asked = hash_sample(base.where("asks").select("id", "tag", "v"), sample, "id", "tag").toArrow()
    if not asked.num_rows:
        return 1.0
    q, own = matrix(asked["v"]), asked["tag"].to_numpy()

    def work(tags: pa.Array, v: pa.ListArray) -> tuple:
        if not len(v):
            return ([],)
        score = matrix(v) @ q.T
        score[tags.to_numpy()[:, None] == own[None, :]] = -np.inf
        return ([np.sort(score, axis=0)[::-1][:k].T.tolist()] + [None] * (len(v) - 1),)

    tops = map_columns(base.select("tag", "v"), lambda b: (work(t, v) for t, v in b), "tops array<array<double>>")
    best = tops.where("tops IS NOT NULL").select(F.posexplode("tops").alias("q", "s")).select("q", F.explode("s").alias("s"))
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("n") <= k)
    edge = {r["q"]: (r["low"], r["many"]) for r in ranked.where("s > double('-inf')").groupBy("q").agg(
        F.min("s").alias("low"), F.count("*").alias("many")).collect()}
    got: dict = {}
    ids = asked["id"].to_pylist()
    for r in found.where(F.col("query_id").isin(ids)).select("query_id", "score").collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    hits = total = 0
    for i, name in enumerate(ids):
        low, many = edge.get(i, (math.inf, 0))
        total += many
        hits += min(many, sum(s >= low - 1e-9 for s in got.get(name, [])))
    return hits / total if total else 1.0
