"""The corpus pipeline: quality rules, near-duplicates, personal data, packing.

Each stage takes the documents its predecessor kept and returns documents with the same columns; the last returns packed
pieces. Stages read nothing but their input and, for the quality rules, the labels of the same folder.

Every stage takes odd rows as its operator does: null and empty texts have too few words and go with the quality rules; very
long texts are taken whole; rows that repeat an id and a text leave one behind (near-duplicates), those that repeat an id
with another text are documents of their own; of equally good copies the one with the smallest id stays, null ids last. Other
columns are carried, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import shelfmark
from shelfmark.llm import near_dedup, packing, pii, quality
from shelfmark.llm.common import documents
from shelfmark.session import shared_dir

# Python workers need not have the package on their path: its functions travel with the task.
cloudpickle.register_pickle_by_value(shelfmark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base tests or a learned rule go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return near_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts."""
    return pii.mask(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of a fixed length."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: Learned rules, sketches and tokenizers are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
