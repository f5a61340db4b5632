"""Listing-shaped inputs derived from the benchmark tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.price import Rates
from ..operators.crawl import sequence_number
from ..operators.listings import index_listings, index_rich, normalize_listings, rich_texts
from ..operators.postings import load_rich, save_rich
from ..session import shared_dir

RATES = Rates(1.37, 0.19, "fixture", "2024-01-02")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw row per part and supplier, with mixed currency marks and gaps."""
    # Dealt by part once, which serves the counting as well as the join with the parts.
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey")
    pairs = items.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    df = pairs.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey")
    )
    key = F.col("p_partkey")
    number = key.cast("string")
    amount = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    price = (
        F.when(key % 50 == 0, "")
        .when(key % 51 == 0, "￥0.00")
        .when(key % 4 == 0, F.concat(F.lit("CA$"), amount))
        .when(key % 4 == 1, F.concat(F.lit("US$"), amount))
        .when(key % 4 == 2, F.concat(F.lit("￥"), amount))
        .otherwise(amount)
    )
    title = F.concat(
        "p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.lit(" PN"), number, F.lit("X"), F.col("p_size").cast("string")
    )
    return df.select(
        F.col("s_name").alias("shop"),
        F.concat("s_name", F.lit("/manifest.json")).alias("source_file"),
        key.alias("row_number"),
        number.alias("offer_id"),
        title.alias("title"),
        price.alias("price"),
        F.col("n").cast("string").alias("sales"),
        F.concat(F.lit("https://detail.example.com/offer/"), number, F.lit(".html")).alias("source_url"),
        F.concat(
            F.lit("https://agent.example.com/products?productLink=https%253A%252F%252Fdetail.example.com%252Foffer%252F"),
            number,
            F.lit(".html"),
        ).alias("agent_url"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("images/"), number, F.lit(".jpg"))).alias("image_file"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised listings; the fixture's image files all exist."""
    return normalize_listings(raw_listings(spark, sf_dir)).withColumn("image_path", F.col("image_file"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_listings(listings(spark, sf_dir))


def rich_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_rich(listings(spark, sf_dir))


def token_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with the texts that postings are built from."""
    return rich_texts(listings(spark, sf_dir))


_STORED: dict[tuple[str, str], str] = {}


def stored_rich(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rich index and its postings, stored in buckets once for a session, as a catalogue has them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/rich-{uuid.uuid4().hex}"
        save_rich(listings(spark, sf_dir), path)
        _STORED[key] = path
    return load_rich(spark, _STORED[key])


def crawl_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings in ten shops, 20 to a page, with repeating keys."""
    events = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    base = events.select(
        "event_id",
        "ts",
        F.concat(F.lit("shop-"), (F.col("user_id") % 10).cast("string")).alias("shop"),
        F.concat(F.lit("K"), ((F.col("event_id") * 7919 + F.col("user_id") * 104729) % 120).cast("string")).alias("row_key"),
        F.when(error, "").otherwise(
            F.concat(F.lit("https://img.example.com/"), F.col("event_id").cast("string"), F.lit(".jpg"))
        ).alias("image_url"),
        F.when(~error, 200).when(F.col("event_id") % 2 == 0, 429).otherwise(403).alias("http_status"),
        F.col("value"),
    )
    numbered = sequence_number(
        base, ["shop"], ["ts", "event_id"], [F.date_trunc("hour", "ts"), F.date_trunc("second", "ts")], "seq"
    )
    return numbered.withColumn("page", ((F.col("seq") - 1) / 20).cast("long") + 1)


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "queued").when(kind.isin("view", "click"), "running")
        .when(kind == "purchase", "completed").otherwise("error")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("item_id"), "ts", status.alias("status")
    )


def shop_prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth supplier is a favourite, every seventh disabled."""
    key = F.col("s_suppkey")
    kind = F.when(key % 5 == 0, "favorite").when(key % 7 == 0, "disabled")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("shop"), kind.alias("kind"))
    return rows.filter(F.col("kind").isNotNull())


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: its member with the smallest id."""
    first = vectors(spark, sf_dir).groupBy("label").agg(F.min_by(F.struct("id", "embedding"), "id").alias("r"))
    return first.select(F.col("label").cast("long").alias("query_id"), "r.embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with the smallest id."""
    return vectors(spark, sf_dir).agg(F.min_by("embedding", "id")).first()[0]
