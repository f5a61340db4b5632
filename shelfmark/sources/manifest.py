"""JSON shop manifests and API record pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import price as P, text as X, url as U
from .files import input_path

# Rows are read as raw text: with a struct schema one element that is no object would lose
# the whole file.
MANIFEST = (
    "shop_name string, source_url string, scraped_at string, pages_visited int, completion_reason string, "
    "stopped_early boolean, status string, price_common_currency string, price_exchange_source string, "
    "price_exchange_date string, saved int, failed int, sort_summaries array<string>, rows array<string>, "
    "_corrupt_record string"
)


def read_manifest_files(spark: SparkSession, root: str, glob: str = "manifest.json", multi_line: bool = True) -> DataFrame:
    """One row per manifest with ``source_file`` and ``mtime``; unreadable ones have ``_corrupt_record``."""
    files = (
        spark.read.schema(MANIFEST)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(root)
    )
    return files.select(
        input_path(root).alias("source_file"), F.unix_micros("_metadata.file_modification_time").alias("mtime"), "*"
    )


def json_fields(row: Column) -> Column:
    """JSON object text to ``map<string,string>``.

    Numeric zero and false become empty (they mean "not given"), while the text "0" stays.
    """
    typed = F.from_json(row, "map<string,variant>")

    def as_text(_, v: Column) -> Column:
        kind, text = F.schema_of_variant(v), v.cast("string")
        number = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
        return (
            F.when(v.isNull() | (kind == "VOID"), F.lit(""))
            .when(kind == "BOOLEAN", F.when(text == "true", F.lit("True")).otherwise(F.lit("")))
            .when(number & (text.try_cast("double") == 0), F.lit(""))
            .otherwise(text)
        )

    return F.transform_values(typed, as_text)


def manifest_rows(manifests: DataFrame) -> DataFrame:
    """Raw rows ``source_file, row_number, fields``; only objects count and are numbered."""
    objects = F.filter(F.col("rows"), lambda r: r.rlike(r"^\s*\{"))
    return manifests.select(
        "source_file", *[c for c in ("shop", "kind") if c in manifests.columns],
        F.posexplode(objects).alias("_pos", "_row"),
    ).select(
        "source_file", *[c for c in ("shop", "kind") if c in manifests.columns],
        (F.col("_pos") + 1).cast("long").alias("row_number"), json_fields(F.col("_row")).alias("fields"),
    )


def read_manifests(spark: SparkSession, root: str, **options) -> DataFrame:
    """Raw rows of all manifests below ``root``."""
    return manifest_rows(read_manifest_files(spark, root, **options))


def manifest_info(manifests: DataFrame) -> DataFrame:
    """What planning needs to know about each manifest."""
    return manifests.select(
        F.col("source_file").alias("path"),
        "source_file",
        *[c for c in ("shop",) if c in manifests.columns],
        "shop_name",
        "source_url",
        "pages_visited",
        "completion_reason",
        "stopped_early",
        "status",
        F.coalesce(F.size("rows"), F.lit(0)).alias("row_count"),
        U.shop_key("source_url").alias("shop_key"),
    )


# Accepted names of an API record's fields, in order of preference.
API_ALIASES = {
    "offer": ["numIid", "itemId", "offerId"],
    "title": ["title", "subject", "name"],
    "promotion": ["promotionPrice"],
    "price": ["price"],
    "image": ["picUrl", "imageUrl", "imgUrl", "pictureUrl"],
    "sales": ["sales", "saleCount", "sold"],
    "source": ["detailUrl", "sourceUrl", "url"],
}


def explode_api_pages(pages: DataFrame, c: str = "body") -> DataFrame:
    """API response texts to records: ``..., pos, fields`` for each object in ``data.records``."""
    records = F.from_json(F.get_json_object(c, "$.data.records"), "array<string>")
    objects = F.filter(records, lambda r: r.rlike(r"^\s*\{"))
    return pages.select("*", F.posexplode(objects).alias("pos", "_r")).withColumn(
        "fields", json_fields(F.col("_r"))
    ).drop("_r")


def rows_from_api(df: DataFrame, fields: str = "fields", site: U.AgentSite = U.DEFAULT_AGENT) -> DataFrame:
    """API records (a field map) to listing columns; other columns are carried along."""

    def pick(name: str) -> Column:
        return X.first_filled(*[F.try_element_at(fields, F.lit(a)) for a in API_ALIASES[name]])

    rest = [c for c in df.columns if c != fields]
    staged = df.select(
        *rest,
        X.clean_text(pick("source")).alias("source_url"),
        X.clean_text(pick("title")).alias("title"),
        P.api_price_text(pick("promotion"), pick("price")).alias("price"),
        X.clean_text(pick("sales")).alias("sales"),
        X.clean_text(pick("image")).alias("image_url"),
        X.clean_text(pick("offer")).alias("_offer"),
    )
    staged = staged.withColumn(
        "offer_id", X.first_filled("_offer", U.offer_id("source_url", profile="live_page"))
    ).drop("_offer")
    currency, value = P.source_currency("price"), P.coerce_number("price")
    return staged.withColumns(
        {
            "price_currency": currency,
            "price_value": value,
            "price_original": F.col("price"),
            "price_original_currency": currency,
            "price_original_value": value,
            f"{site.name}_url": U.agent_url("source_url", site),
            "source_1688_url": F.col("source_url"),
            "image_file": U.image_file("offer_id", "title", "image_url"),
        }
    )


def latest_rates(observations: DataFrame, c: str = "observations", usd: str = "FXUSDCAD", cny: str = "FXCNYCAD",
                 source: str = "Bank of Canada") -> DataFrame:
    """One rates row from saved rate documents.

    ``c`` is an array of JSON texts ``{"d": date, series: {"v": value}}``. The last filled
    value in document order counts for each series, whatever its date.
    """
    entries = observations.select(F.posexplode(c).alias("pos", "o"))

    def last(series: str) -> Column:
        value = F.nullif(F.get_json_object("o", f"$.{series}.v"), F.lit(""))
        entry = F.struct(value.try_cast("double").alias("v"), F.coalesce(F.get_json_object("o", "$.d"), F.lit("")).alias("d"))
        return F.max_by(F.when(value.isNotNull(), entry), F.when(value.isNotNull(), F.col("pos")))

    both = entries.agg(last(usd).alias("usd"), last(cny).alias("cny"))
    return both.select(
        F.col("usd.v").alias("usd_to_cad"),
        F.col("cny.v").alias("cny_to_cad"),
        F.when(F.col("cny.v") > 0, F.col("usd.v") / F.col("cny.v")).alias("usd_to_cny"),
        F.lit(source).alias("source"),
        X.later_date("usd.d", "cny.d").alias("source_date"),
    )


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """:func:`latest_rates` of a saved observations document."""
    doc = spark.read.schema("observations array<string>").option("multiLine", True).json(path)
    return latest_rates(doc)
