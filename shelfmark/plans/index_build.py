"""From source files to a stored, searchable index. Every step is lazy; one write runs it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.images import resolve_images
from ..operators.listings import alias_picker, index_listings, normalize_listings, union_sources
from ..operators.prices import PRICE_COLUMNS, normalize_prices
from ..sources.files import discover_sources, manifest_folders, placement, read_image_inventory
from ..sources.manifest import manifest_rows, read_manifest_files
from ..sources.sinks import save_index
from ..sources.tabular import load_table


def load_sources(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, errors, manifests)``: raw rows of all sources that count, and what failed.

    A file that cannot be read adds an entry to ``errors`` and the load goes on.
    """
    here = placement("source_file")

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({c: here[c] for c in ("kind", "shop", "shop_dir")})

    manifests = placed(read_manifest_files(spark, root)).filter("kind = 'manifest'").drop("shop_dir")
    good = manifests.filter(F.col("_corrupt_record").isNull())
    # Shop and kind follow from the path. Only the folders with manifests are a table, a row per shop.
    taken = manifest_folders(discover_sources(spark, root))
    tables = placed(load_table(spark, root)).filter("kind = 'table'").join(taken, "shop_dir", "left_anti").drop("shop_dir")
    rows = union_sources(manifest_rows(good), tables.filter(F.col("error").isNull()).drop("error"))
    # Spark answers no query that reads the corrupt-record column alone, so the text says
    # what was left of the file.
    kind = F.when(F.size("rows") > 0, F.lit("damaged JSON manifest")).otherwise(F.lit("not a JSON manifest"))
    errors = manifests.filter(F.col("_corrupt_record").isNotNull()).select("source_file", kind.alias("error"))
    return rows, errors.unionByName(tables.filter(F.col("error").isNotNull()).select("source_file", "error")), good


def build_listings(spark: SparkSession, root: str, with_images: bool = True) -> DataFrame:
    """Listings of a data root."""
    rows, _, _ = load_sources(spark, root)
    listings = normalize_listings(rows)
    return resolve_images(listings, read_image_inventory(spark, root)) if with_images else listings


def build_index(spark: SparkSession, root: str, with_images: bool = True) -> DataFrame:
    """Listings of a data root with their search columns."""
    return index_listings(build_listings(spark, root, with_images))


def publish_index(spark: SparkSession, root: str, path: str) -> int:
    return save_index(build_listings(spark, root), path)


def normalize_all(spark: SparkSession, root: str, rates, fields: list[str]) -> DataFrame:
    """All stored rows with prices in the common currency; ``fields`` are the listing columns
    to keep, found under either spelling of their header."""
    rows, _, _ = load_sources(spark, root)
    pick = alias_picker(rows)
    names = list(dict.fromkeys([*fields, *PRICE_COLUMNS]))
    flat = rows.select("source_file", "shop", "kind", "row_number", *[pick(f).alias(f) for f in names])
    return normalize_prices(flat, rates)
