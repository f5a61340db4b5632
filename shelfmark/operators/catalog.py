"""Catalogue and shop statistics, preferences and images per shop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .listings import has_image


def shop_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy("shop").agg(F.count("*").alias("listings"))


def catalog_stats(listings: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One row: listings, shops, sources.

    Distinct values are counted over grouped counts, so the wide table is shuffled never
    and its groups once.
    """
    shops = shop_counts(listings).agg(F.coalesce(F.sum("listings"), F.lit(0)).alias("rows"), F.count("*").alias("shops"))
    files = sources if sources is not None else listings.groupBy("source_file").agg(F.count("*").alias("n"))
    return shops.select(
        F.col("rows").alias("total_rows"),
        F.col("shops").alias("total_shops"),
        files.agg(F.count("*").alias("n")).scalar().alias("total_sources"),
    )


def source_counts(sources: DataFrame, listings: DataFrame) -> DataFrame:
    """Rows per source file; files without rows count 0."""
    rows = listings.groupBy("source_file").agg(F.count("*").alias("rows"))
    named = sources.withColumnRenamed("path", "source_file") if "path" in sources.columns else sources
    return named.join(rows, "source_file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def shop_urls(manifests: DataFrame) -> DataFrame:
    """First non-empty URL per shop in file order."""
    filled = manifests.filter(X.clean_text("source_url") != "")
    order = F.struct(F.lower("source_file"), F.col("source_file"))
    return filled.groupBy("shop").agg(F.min_by(X.clean_text("source_url"), order).alias("shop_url"))


def shop_map(counts: DataFrame, key: str = "shop", value: str = "listings", per_map: int = 10_000) -> DataFrame:
    """Maps from shop to value: ``bucket, shop_map``.

    A catalogue of up to ``per_map`` shops gives one map; more are spread over several, so
    that no map grows with the data.
    """
    n = F.greatest(F.lit(1), F.ceil(counts.agg(F.count("*").alias("n")).scalar() / per_map))
    spread = counts.withColumn("bucket", F.pmod(F.xxhash64(key), n))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key), F.col(value))))
    return spread.groupBy("bucket").agg(F.map_from_entries(pairs).alias("shop_map"))


def shops(listings: DataFrame) -> DataFrame:
    """Distinct shops in case-insensitive order."""
    return listings.select("shop").distinct().orderBy(F.lower("shop"), "shop")


def _flags(prefs: DataFrame) -> DataFrame:
    return prefs.groupBy("shop").agg(
        F.bool_or(F.col("kind") == "favorite").alias("favorite"), F.bool_or(F.col("kind") == "disabled").alias("disabled")
    )


def shop_panel(listings: DataFrame, prefs: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Shops with count, favourite and disabled marks and saved URL; favourites come first."""
    panel = shop_counts(listings).join(_flags(prefs), "shop", "left")
    if urls is not None:
        panel = panel.join(urls, "shop", "left")
    else:
        panel = panel.withColumn("shop_url", F.lit(""))
    no = F.lit(False)
    panel = panel.select(
        "shop",
        "listings",
        F.coalesce("favorite", no).alias("favorite"),
        F.coalesce("disabled", no).alias("disabled"),
        X.or_empty("shop_url").alias("shop_url"),
    )
    return panel.orderBy(F.col("favorite").desc(), F.lower("shop"), "shop")


def shop_summary(panel: DataFrame) -> DataFrame:
    """One row: shops, active shops, favourite shops."""
    return panel.agg(
        F.count("*").alias("shops"),
        F.count_if(~F.col("disabled")).alias("active"),
        F.count_if("favorite").alias("favorites"),
    )


def clean_prefs(prefs: DataFrame, known: DataFrame) -> DataFrame:
    """Preferences of shops that exist."""
    return prefs.join(known.select("shop").distinct(), "shop", "left_semi")


def merge_prefs(own: DataFrame, incoming: DataFrame) -> DataFrame:
    """Favourites are united; the disabled list is the incoming one."""
    favorites = own.filter("kind = 'favorite'").unionByName(incoming.filter("kind = 'favorite'"))
    return favorites.unionByName(incoming.filter("kind = 'disabled'")).select("shop", "kind").distinct()


def best_name(df: DataFrame, by: list[str], name: str, pos: str, agent: str = "agent", fallback: str | None = None) -> DataFrame:
    """Best shop name per group: one that says something, then the longest, then the first."""
    text = X.clean_text(name)
    rank = F.struct(~X.is_generic_name(name, agent), F.length(text), -F.col(pos))
    best = df.groupBy(*by).agg(F.max_by(F.when(text != "", text), F.when(text != "", rank)).alias("_n"))
    default = f"{agent.capitalize()} Shop" if fallback is None else fallback
    return best.select(*by, X.safe_name(X.first_filled("_n", F.lit(default)), "queue", default).alias("shop_name"))


def image_stats(rows: DataFrame, saved: Column | None = None, failed: Column | None = None) -> DataFrame:
    """Images saved and failed per shop: a stored path is a success, an error a failure."""
    if saved is None:
        saved = X.or_empty("zip_path") != "" if "zip_path" in rows.columns else has_image()
    if failed is None:
        failed = X.or_empty("error") != ""
    return rows.groupBy("shop").agg(
        F.count_if(saved).alias("saved"), F.count_if(failed).alias("failed"), F.count("*").alias("rows")
    )
