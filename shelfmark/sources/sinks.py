"""Writers: CSV, manifests, the stored index, vectors and state documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import price as P, text as X
from ..operators.listings import derived_columns, index_listings, with_derived

MANIFEST_ROWS = 10_000
# A CSV file is read by one task, since its cells may hold line breaks; larger tables become several files.
CSV_ROWS = 100_000


def csv_columns(existing: list[str], agent: str = "agent") -> list[str]:
    """Common columns first, then others in first-seen order, then the outcome columns."""
    common = [
        "offer_id", "title", "price", "price_currency", "price_value", "price_original", "price_original_currency",
        "price_original_value", "price_exchange_source", "price_exchange_date", "sales", f"{agent}_url",
        "source_url", "source_1688_url", "image_url", "image_file",
    ]
    named = [" ".join(c.split()) for c in existing]
    return list(dict.fromkeys([*common, *filter(None, named), "zip_path", "saved", "error"]))


def listing_table(df: DataFrame, agent: str = "agent") -> DataFrame:
    """Export columns in order, as clean text; absent ones are empty."""
    def cell(c: str) -> Column:
        return X.clean_text(F.col(f"`{c}`").cast("string")) if c in df.columns else F.lit("")

    return df.select(*[cell(c).alias(c) for c in csv_columns(df.columns, agent)])


def write_listing_csv(df: DataFrame, path: str, agent: str = "agent") -> None:
    listing_table(df, agent).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).option("maxRecordsPerFile", CSV_ROWS).csv(path)


def shop_manifests(rows: DataFrame, meta: DataFrame, rates, per_manifest: int = MANIFEST_ROWS) -> DataFrame:
    """Manifest documents per shop.

    ``rows`` has ``shop``, a unique ``id`` and the listing columns; ``meta`` one row per shop
    with crawl facts and ``status`` (``completed`` or ``checkpoint``). A shop with more than
    ``per_manifest`` rows gets several manifests, which the reader takes as one shop, so no
    document has to hold a large shop.
    """
    rates = P.rates_column(rates)
    saved = F.count_if(X.or_empty("zip_path") != "") if "zip_path" in rows.columns else F.lit(0).cast("long")
    failed = F.count_if(X.or_empty("error") != "") if "error" in rows.columns else F.lit(0).cast("long")
    sizes = rows.groupBy("shop").agg(F.count("*").alias("_n"), saved.alias("saved"), failed.alias("failed"))
    parts = sizes.select("shop", F.ceil(F.col("_n") / per_manifest).alias("_parts"))
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "shop"]))
    cut = rows.join(parts, "shop").select(
        "shop", F.pmod(F.xxhash64("id"), F.col("_parts")).alias("part"), F.struct("id", body.alias("json")).alias("r")
    )
    packed = cut.groupBy("shop", "part").agg(
        F.transform(F.sort_array(F.collect_list("r")), lambda r: r["json"]).alias("_rows")
    )
    facts = packed.join(sizes.drop("_n"), "shop").join(meta, "shop", "left")
    head = F.to_json(
        F.struct(
            F.col("shop").alias("shop_name"),
            *[c for c in ("source_url", "scraped_at", "pages_visited", "completion_reason", "stopped_early", "status")
              if c in meta.columns],
            F.lit(P.CANONICAL).alias("price_common_currency"),
            X.or_empty(rates["source"]).alias("price_exchange_source"),
            X.or_empty(rates["source_date"]).alias("price_exchange_date"),
            "saved",
            "failed",
        )
    )
    # Rows are JSON already, so they are set into the head instead of being parsed again.
    document = F.concat(
        F.regexp_replace(head, r"\}$", ""), F.lit(',"rows":['), F.array_join("_rows", ","), F.lit("]}")
    )
    return facts.select("shop", "part", document.alias("value"))


def write_manifests(rows: DataFrame, meta: DataFrame, rates, path: str, per_manifest: int = MANIFEST_ROWS) -> None:
    """One manifest per line below ``shop=<name>/``; read back with ``multi_line=False``."""
    shop_manifests(rows, meta, rates, per_manifest).select("shop", "value").write.mode("overwrite").partitionBy(
        "shop"
    ).text(path)


def save_index(index: DataFrame, path: str, canonical: str = P.CANONICAL) -> int:
    """Write a new version of the index and make it current; returns the version.

    Listings without search columns get them after they were dealt, so that these are not shuffled. What follows at little
    cost from other columns is not stored; :func:`load_index` adds it.

    Files are laid out by shop and title, so filters on the shop skip row groups and a large
    shop still spreads over many files. The one-row entry in ``versions`` comes last, so
    readers never see half an index.
    """
    stored = index.drop(*derived_columns())
    dealt = stored.repartitionByRange(F.col("shop"), F.col("title"), F.col("id"))
    if not any(c.startswith("_") for c in index.columns):
        index = index_listings(dealt)
        dealt = index.drop(*derived_columns())
    return _write_version(dealt, index.columns, path, canonical)


def _write_version(rows: DataFrame, columns: list[str], path: str, canonical: str) -> int:
    spark = rows.sparkSession
    version = current_version(spark, path, None)
    version = 1 if version is None else version + 1
    rows.sortWithinPartitions("shop", "title").write.mode("overwrite").option("compression", "zstd").parquet(
        f"{path}/data/version={version}")
    # Column names tell whether a stored index is of this format.
    entry = spark.range(1).select(
        F.lit(version).alias("version"), F.lit(canonical).alias("canonical"), F.array(*map(F.lit, columns)).alias("columns")
    )
    entry.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def current_version(spark: SparkSession, path: str, canonical: str | None = P.CANONICAL) -> int | None:
    """Newest version, or None when there is none or it holds another currency."""
    try:
        entries = spark.read.parquet(f"{path}/versions")
    except AnalysisException:
        return None
    last = entries.agg(F.max("version"), F.max_by("canonical", "version")).first()
    if last[0] is None or (canonical is not None and last[1] != canonical):
        return None
    return last[0]


REQUIRED = {"id", "shop", "title", "price_value", "source_file", "_title", "_blob", "_offer"}


def load_index(spark: SparkSession, path: str, canonical: str = P.CANONICAL) -> DataFrame | None:
    """The stored index, or None if it is absent, of another currency or malformed."""
    index = _stored_rows(spark, path, canonical)
    return None if index is None else with_derived(index)


def _stored_rows(spark: SparkSession, path: str, canonical: str = P.CANONICAL) -> DataFrame | None:
    version = current_version(spark, path, canonical)
    if version is None:
        return None
    index = spark.read.parquet(f"{path}/data/version={version}")
    return index if REQUIRED <= set(index.columns) else None


def drop_shop(spark: SparkSession, path: str, shop: str) -> int | None:
    """Publish the index without one shop. Source files are left alone.

    The stored rows lie by shop and title already, so they are written as they are read and not dealt again.
    """
    rows = _stored_rows(spark, path)
    if rows is None:
        return None
    return _write_version(rows.filter(F.col("shop") != shop), with_derived(rows).columns, path, P.CANONICAL)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors with what identifies them. Write to another path than the one being reused."""
    vectors.select("vector_key", "id", "path", "size", "mtime", F.col("embedding").cast("array<float>")).write.mode(
        "overwrite"
    ).parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    schema = "vector_key string, id string, path string, size long, mtime long, embedding array<float>"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def save_queue(items: DataFrame, path: str) -> None:
    """All items, oldest first."""
    items.orderBy("enqueued", "item_id").write.mode("overwrite").json(path)


def prefs_rows(prefs: DataFrame) -> DataFrame:
    """Clean, distinct ``shop, kind`` rows in case-insensitive order."""
    clean = prefs.select(X.clean_text("shop").alias("shop"), "kind").filter("shop <> ''").distinct()
    return clean.orderBy("kind", F.lower("shop"), "shop")


def save_prefs(prefs: DataFrame, path: str) -> None:
    prefs_rows(prefs).write.mode("overwrite").json(path)


def merge_repair_cache(old_prices: DataFrame, new_prices: DataFrame, old_failures: DataFrame,
                       new_failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New prices replace old ones; a key with a price has no failure any more."""
    prices = new_prices.unionByName(old_prices.join(new_prices.select("key"), "key", "left_anti"))
    failures = new_failures.unionByName(old_failures.join(new_failures.select("key"), "key", "left_anti"))
    return prices, failures.join(new_prices.select("key"), "key", "left_anti")
