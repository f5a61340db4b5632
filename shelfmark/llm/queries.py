"""Registered queries of the operators in this folder: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.llm import (
    alignment, binary_output, chat, fingerprints, licenses, near_dedup, negatives, neighbours, packing, pii, quality, sharding,
    transducer,
)
from shelfmark.llm.common import documents


def op1_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.pack_matrix(documents(spark, sf_dir))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and one full of control strings; digest what is read back from the output."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    read = chat.read_back(chat.format_conversations(turns.unionByName(tricky)))

    def joined(learned: bool) -> Column:
        cells = F.filter("turns", lambda t: t.learn) if learned else F.col("turns")
        return F.array_join(F.transform(
            cells, lambda t: t.text if learned else F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")

    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined(False), 256).alias("turns_sha256"),
        F.length(joined(True)).cast("long").alias("loss_chars"), F.sha2(joined(True), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"), F.col("rewritten").alias("rewritten_prefixes"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir), shards=sharding.SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding them gives the text again."""
    docs = documents(spark, sf_dir)
    return transducer.encode_checked(docs)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id has another label first, so that some near rows count as different."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(embeddings(spark, sf_dir).withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_binary_output": op1_binary_output,
    "op2_chat_format": op2_chat_format,
    "op3_license_scan": op3_license_scan,
    "op4_shards": op4_shards,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality_rules": op6_quality_rules,
    "op7_pieces": op7_pieces,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_personal_data": op9_personal_data,
    "op10_pack": op10_pack,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_token_alignment": op12_token_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}
