"""Small state documents: preferences, queue items, repair cache. Unreadable means empty."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X

PREFS = "favorites array<string>, disabled array<string>"
QUEUE_ITEM = (
    "id string, url string, status string, created_at string, started_at string, finished_at string, "
    "message string, shop_name string, output_dir string, listing_count int, images_saved int, images_failed int, "
    "progress_phase string, progress_current int, progress_total int, progress_percent double, error string, "
    "retry_count int, retried_from_item_id string, force_recrawl boolean"
)
QUEUE = f"last_error string, items array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in QUEUE_ITEM.split(','))}>>"
REPAIRS = "prices map<string,struct<price:string,value:double>>, failures map<string,string>"


def parse_json(c: Column | str, schema: str | T.DataType) -> Column:
    """Parsed JSON; text of the wrong shape becomes NULL."""
    return F.from_json(X.col(c), schema, {"mode": "PERMISSIVE"})


def rows_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def read_state(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """A state document; an absent or unreadable one gives no rows."""
    try:
        df = (
            spark.read.schema(schema + ", _corrupt_record string")
            .option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path)
        )
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_prefs(spark: SparkSession, path: str) -> DataFrame:
    """``shop, kind`` with kind ``favorite`` or ``disabled``."""
    doc = read_state(spark, path, PREFS)

    def listed(c: str, kind: str) -> DataFrame:
        return doc.select(F.explode(X.string_list(c)).alias("shop"), F.lit(kind).alias("kind"))

    return listed("favorites", "favorite").unionByName(listed("disabled", "disabled"))


def load_prefs(spark: SparkSession, path: str) -> DataFrame:
    """Preferences stored as rows."""
    return read_state(spark, path, "shop string, kind string", multi_line=False)


def read_queue(spark: SparkSession, path: str, restarted: bool = True) -> DataFrame:
    """Queue items with an id and a URL; interrupted ones wait again."""
    items = read_state(spark, path, QUEUE).select(F.posexplode("items").alias("enqueued", "i")).select("enqueued", "i.*")
    items = items.filter((X.or_empty("id") != "") & (X.or_empty("url") != "")).withColumnRenamed("id", "item_id")
    items = items.withColumn("status", X.first_filled("status", F.lit("queued")))
    if restarted:
        cut = F.col("status") == "running"
        items = items.withColumns(
            {
                "started_at": F.when(cut, F.lit("")).otherwise(F.col("started_at")),
                "finished_at": F.when(cut, F.lit("")).otherwise(F.col("finished_at")),
                "message": F.when(cut, F.lit("Recovered after restart. Waiting to resume.")).otherwise(F.col("message")),
                "error": F.when(cut, F.lit("")).otherwise(F.col("error")),
                "status": F.when(cut, F.lit("queued")).otherwise(F.col("status")),
            }
        )
    return items


def load_queue(spark: SparkSession, path: str, restarted: bool = True) -> DataFrame:
    """Queue items stored as rows (:func:`sinks.save_queue`); after a restart, running ones wait again."""
    items = read_state(spark, path, "item_id string, status string, seq long, ts string, enqueued long, url string", multi_line=False)
    waiting = F.when(F.col("status") == "running", F.lit("queued")).otherwise(F.col("status"))
    return items.withColumn("status", waiting) if restarted else items


def read_repairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(prices, failures)`` of a repair cache."""
    doc = read_state(spark, path, REPAIRS)
    prices = doc.select(F.explode("prices").alias("key", "p")).select("key", "p.price", "p.value")
    return prices, doc.select(F.explode("failures").alias("key", "error"))
