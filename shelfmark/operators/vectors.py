"""Exact nearest-neighbour search over unit vectors and incremental vector builds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import vector_key

# Query vectors sent to every task: at most this many numbers (32 MB as float64).
BROADCAST_NUMBERS = 4_000_000
# Result rows a task may hold: its best k for every query.
TASK_ROWS = 4_000_000
# Rows of a query block and of a vector block beyond that.
QUERY_BLOCK, VECTOR_BLOCK = 1_000, 50_000
RESULT = "query_id long, id long, score double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.asarray(column.tolist(), dtype=np.float64)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` rows of each query out of long arrays, best first, ties by id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    begins = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(begins, np.diff(np.r_[begins, len(query)]))
    keep = place < k
    return query[keep], ids[keep], score[keep]


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query number, id, score)`` of the best ``k`` per row of a score matrix (queries x vectors)."""
    n = scores.shape[1]
    if n > k:
        cut = np.partition(scores, n - k, axis=1)[:, n - k, None]
        rows, columns = np.nonzero(scores >= cut)  # ties at the border are settled by id
    else:
        rows, columns = (x.ravel() for x in np.indices(scores.shape))
    return _best(rows, ids[columns], scores[rows, columns], k)


# Parts that a query's rows are ranked in before the final ranking.
MERGE_PARTS = 32


def _merge(partial: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows per query out of what the tasks kept, in two levels, so that no task gets all of a query's."""
    order = [F.col("score").desc(), F.col("id")]
    split = partial.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(MERGE_PARTS)))
    within = F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*order))
    few = split.withColumn("_place", within).filter(F.col("_place") <= k).drop("_part", "_place")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return few.withColumn("rank", rank).filter(F.col("rank") <= k)


def _scan(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Compare every vector with all queries where it lies; a task emits ``k`` rows per query."""

    def best_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            found = _top(queries @ _matrix(batch["embedding"]).T, batch["id"].to_numpy(), k)
            kept = found if kept is None else _best(*map(np.concatenate, zip(kept, found)), k)
        if kept is not None:
            yield pd.DataFrame({"query_id": query_ids[kept[0]], "id": kept[1], "score": kept[2]})

    return vectors.select("id", "embedding").mapInPandas(best_of_task, RESULT)


def _blocks(vectors: DataFrame, queries: DataFrame, n_vectors: int, n_queries: int, k: int) -> DataFrame:
    """Both sides cut into blocks; every pair of blocks is one matrix product in one task.

    Blocks have a bounded size whatever the data, and a pair returns ``k`` rows per query.
    """
    nv, nq = -(-n_vectors // VECTOR_BLOCK), -(-n_queries // QUERY_BLOCK)
    v = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(nv)).alias("vb"))
    q = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("qb"))
    v = v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<long>")))
    q = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)).cast("array<long>")))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        found = _top(_matrix(right["embedding"]) @ _matrix(left["embedding"]).T, left["id"].to_numpy(), k)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[found[0]], "id": found[1], "score": found[2]})

    return v.groupBy("qb", "vb").cogroup(q.groupBy("qb", "vb")).applyInPandas(compare, RESULT)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 200) -> DataFrame:
    """Top ``k`` vectors for each query: ``query_id, id, score, rank``.

    ``vectors`` has ``id, embedding`` and ``queries`` has ``query_id, embedding``, all of
    unit length, so the dot product is the cosine. Ties go to the smaller id. Queries are
    sent to the vectors while they are few, which is checked; beyond that both sides are
    cut into blocks.
    """
    k = int(k)
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], RESULT + ", rank int")
    # A first look that reads no more queries than may be broadcast.
    width = queries.select(F.max(F.size("embedding"))).first()[0] or 1
    most = max(1, min(BROADCAST_NUMBERS // width, TASK_ROWS // k))
    few = queries.select("query_id", "embedding").limit(most + 1).toPandas()
    if len(few) <= most:
        if not len(few):
            return vectors.sparkSession.createDataFrame([], RESULT + ", rank int")
        return _merge(_scan(vectors, few["query_id"].to_numpy(), _matrix(few["embedding"]), k), k)
    return _merge(_blocks(vectors, queries, vectors.count(), queries.count(), k), k)


def knn(vectors: DataFrame, query: list[float], k: int = 200, ids: DataFrame | None = None) -> DataFrame:
    """Top ``k`` for one query vector: ``id, score, rank``.

    ``ids`` (column ``id``) restricts the search; unknown ids are ignored and an empty
    table means no restriction.
    """
    k = int(k)
    if ids is not None and not ids.isEmpty():
        vectors = vectors.join(ids.select("id").distinct(), "id", "left_semi")
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "id long, score double, rank int")
    found = _scan(vectors, np.asarray([0]), np.asarray([query], dtype=np.float64), k)
    return _merge(found, k).select("id", "score", "rank")


def image_candidates(listings: DataFrame, inventory: DataFrame) -> DataFrame:
    """Listings with an existing image file and the key under which its vector is kept."""
    found = listings.filter((F.col("id") != "") & (F.col("image_path") != "")).join(
        inventory.select(F.col("path").alias("image_path"), "size", "mtime"), "image_path"
    )
    return found.select(
        "id", F.col("image_path").alias("path"), "size", "mtime",
        vector_key("id", "image_path", "size", "mtime").alias("vector_key"),
    )


def vectors_pending(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Images without a current vector."""
    return candidates.join(cache.select("vector_key").distinct(), "vector_key", "left_anti")


def vectors_stale(candidates: DataFrame, cache: DataFrame) -> bool:
    """Whether new image data arrived since the last build."""
    return not vectors_pending(candidates, cache).isEmpty()


def refresh_vectors(candidates: DataFrame, cache: DataFrame,
                    encode: Callable[[list[str]], np.ndarray], batch: int = 128) -> DataFrame:
    """Vectors for all candidates: reused where the key is known, encoded where it is not.

    ``encode`` gets a list of image paths (at most ``batch``) and returns one vector per
    path; it runs inside the tasks. Only new images reach it.
    """
    known = cache.select("vector_key", "embedding").dropDuplicates(["vector_key"]).withColumn("reused", F.lit(True))
    # One join tells known from new; both parts of its rows read the same exchanges.
    joined = candidates.join(known, "vector_key", "left")
    columns = ["vector_key", "id", "path", "size", "mtime"]
    reused = joined.filter("reused")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                vectors = np.asarray(encode(part["path"].tolist()), dtype=np.float64)
                lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = (vectors / np.where(lengths > 0, lengths, 1)).astype(np.float32)
                yield part.assign(embedding=list(unit), reused=False)

    pending = joined.filter("reused IS NULL").select(*columns)
    schema = "vector_key string, id string, path string, size long, mtime long, embedding array<float>, reused boolean"
    return reused.select(*columns, "embedding", "reused").unionByName(
        pending.mapInPandas(run, schema)
    )


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Counts of an index build: total, reused, encoded."""
    return vectors.agg(
        F.count("*").alias("total"),
        F.count_if("reused").alias("reused"),
        F.count_if(~F.col("reused")).alias("encoded"),
    )
