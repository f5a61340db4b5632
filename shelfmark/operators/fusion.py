"""Putting text and vector results together.

Scaling needs the extremes and the size of the vector result. They are plain aggregates
used as scalar subqueries, so no result passes through a single window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Vector-only rows join the result up to this rank, unless the caller says otherwise.
INCLUDE_RANK = 300
MIN_SPREAD = 0.0001


def scale(vectors: DataFrame) -> DataFrame:
    """Vector results (``id, score, rank`` from 1) with ``scaled`` (0 to 1) and ``rank_boost``."""
    stats = vectors.agg(
        F.struct(F.max("score").alias("hi"), F.min("score").alias("lo"), F.count("*").alias("n")).alias("s")
    ).scalar()
    spread = F.greatest(F.lit(MIN_SPREAD), stats["hi"] - stats["lo"])
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") - stats["lo"]) / spread))
    boost = 1 - (F.col("rank") - 1) / F.greatest(stats["n"], F.lit(1))
    return vectors.select("id", F.col("score").alias("image_score"), "rank", scaled.alias("scaled"), boost.alias("rank_boost"))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def fuse_boost(text: DataFrame, vectors: DataFrame, include_rank: int | None = INCLUDE_RANK) -> DataFrame:
    """Text matches lifted by their vector score, plus vector-only rows that are strong and rank within ``include_rank``
    (None: any rank).

    ``text`` has ``id, score, exact_terms, matched_terms, title_terms, smart_guess``.
    """
    v = scale(vectors).withColumn("boost", F.col("scaled") * 300 + F.col("rank_boost") * 60)
    both = text.join(v, "id", "full_outer")
    in_text = F.col("score").isNotNull()
    strong = F.col("scaled") >= 0.72
    if include_rank is not None:
        strong = strong & (F.col("rank") <= include_rank)
    return both.filter(in_text | strong).select(
        "id",
        (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"),
        _zero("exact_terms"),
        _zero("matched_terms"),
        _zero("title_terms"),
        F.coalesce("image_score", F.lit(0.0)).alias("image_score"),
        F.when(in_text, F.coalesce("smart_guess", F.lit(False)) | F.coalesce(F.col("scaled") >= 0.62, F.lit(False)))
        .otherwise(F.lit(True))
        .alias("smart_guess"),
    )


def fuse_rerank(vectors: DataFrame, relevance: DataFrame) -> DataFrame:
    """Vector results reranked with text relevance.

    If any row has a text hit, rows without one stay only with a score of 260 or more.
    """
    scored = scale(vectors).join(relevance, "id").select(
        "id",
        (F.col("score") + F.col("scaled") * 260 + F.col("rank_boost") * 70).alias("score"),
        "exact_terms",
        "matched_terms",
        "title_terms",
        "image_score",
    )
    any_hit = scored.agg(F.max("matched_terms").alias("m")).scalar()
    keep = (F.coalesce(any_hit, F.lit(0)) <= 0) | (F.col("matched_terms") > 0) | (F.col("score") >= 260)
    return scored.filter(keep)


def fuse_image(text: DataFrame, vectors: DataFrame) -> DataFrame:
    """Text matches that are also in the vector result, with their vector score."""
    return text.join(vectors.select("id", F.col("score").alias("image_score")), "id")
