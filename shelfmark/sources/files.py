"""Discovery of source files and of image files below a data root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X, url as U

LOOSE_SHOP = "workspace"
COLLECTED_DIR = "scraped data"
SYSTEM_DIRS = ("src", ".git", "__pycache__", ".catalog_cache")
SOURCE_GLOB = "*.{json,csv,xlsx}"
IMAGE_GLOB = "*.{jpg,jpeg,png,webp,gif,bmp,svg}"
RAW_SCHEMA = "source_file string, row_number long, fields map<string,string>"


def file_meta(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``path, size, mtime`` of files below ``root``; contents are not opened."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return files.select(
        U.relative_path("path", root).alias("path"),
        F.col("length").alias("size"),
        F.unix_micros("modificationTime").alias("mtime"),
    )


def input_path(root: str) -> Column:
    """Path below ``root`` of the file a row is read from."""
    return U.relative_path(F.col("_metadata.file_path"), root)


def placement(path: Column | str = "path", collected: str = COLLECTED_DIR,
              skip: tuple[str, ...] = SYSTEM_DIRS) -> dict[str, Column]:
    """What the path of a file, relative to the root, says: its ``kind`` (NULL: no source), ``suffix``, ``shop`` and ``shop_dir``.

    A folder below the root, or below the collected-data folder, is one shop. Files directly
    in the root belong to ``workspace``, files directly in the collected-data folder to that
    folder; such loose files have no ``shop_dir``.
    """
    path = X.col(path)
    parts = F.split(path, "/")
    name, suffix = F.element_at(parts, -1), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    top, depth = parts[0], F.size(parts)
    system = (depth > 1) & top.isin(list(skip))
    kind = F.when(name == "manifest.json", F.lit("manifest")).when(suffix.isin("csv", "xlsx"), F.lit("table"))
    nested = top == collected
    shop = (
        F.when(depth == 1, F.lit(LOOSE_SHOP))
        .when(nested & (depth > 2), F.try_element_at(parts, F.lit(2)))
        .otherwise(top)
    )
    shop_dir = F.when(depth == 1, F.lit(None)).when(
        nested, F.when(depth > 2, F.concat_ws("/", top, F.try_element_at(parts, F.lit(2))))
    ).otherwise(top)
    return {"kind": F.when(~system, kind), "suffix": suffix, "shop": shop, "shop_dir": shop_dir}


def discover_sources(spark: SparkSession, root: str, collected: str = COLLECTED_DIR,
                     skip: tuple[str, ...] = SYSTEM_DIRS) -> DataFrame:
    """Source files with their shop: ``path, size, mtime, kind, shop, shop_dir`` (see :func:`placement`)."""
    found = file_meta(spark, root, SOURCE_GLOB).withColumns(placement("path", collected, skip))
    return found.filter(F.col("kind").isNotNull())


def manifest_folders(sources: DataFrame) -> DataFrame:
    """The shop folders that have a manifest."""
    return sources.filter("kind = 'manifest' AND shop_dir IS NOT NULL").select("shop_dir").distinct()


def apply_precedence(sources: DataFrame) -> DataFrame:
    """Where a shop folder has manifests, its tables are ignored; loose files all stay."""
    with_manifest = manifest_folders(sources)
    tables = sources.filter("kind = 'table'").join(with_manifest, "shop_dir", "left_anti")
    return sources.filter("kind = 'manifest'").unionByName(tables)


def read_image_inventory(spark: SparkSession, root: str, glob: str = IMAGE_GLOB) -> DataFrame:
    """``path, size, mtime`` of the image files below a root."""
    return file_meta(spark, root, glob)


def decode_data_urls(df: DataFrame, c: str, out: str = "image_bytes") -> DataFrame:
    """Bytes of inline ``data:`` images, base64 or percent text; NULL for anything else."""
    head = F.regexp_extract(X.or_empty(c), "(?s)^data:([^,]*),", 1)
    body = F.regexp_extract(X.or_empty(c), "(?s)^data:[^,]*,(.*)$", 1)
    packed = F.contains(F.lower(head), F.lit(";base64"))
    inline = X.or_empty(c).rlike("(?s)^data:[^,]*,")
    data = F.when(packed, F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(U.unquote(body), "UTF-8"))
    return df.withColumn(out, F.when(inline, data))


def decode_report(decoded: DataFrame, out: str = "image_bytes") -> DataFrame:
    return decoded.agg(F.count_if(F.col(out).isNotNull()).alias("saved"), F.count_if(F.col(out).isNull()).alias("skipped"))


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
