"""Weighted rendezvous hashing of record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm import common


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard whose score -weight / ln(u(key, shard)) is highest; ties go to the higher number.

    A further shard only ever wins keys for itself, and a shard's weight is its expected share.
    """
    scores = []
    for number, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(number)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(number).alias("shard")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign_shards(docs: DataFrame, weights: list[float], more: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, and with ``more`` the shard under these weights as grown_shard.

    The key is the doc_id alone, so equal ids share a shard whatever their texts, and so do all null ids. Size is the text's UTF-8 bytes (null: none) plus one, its crc32 is that of these bytes. Slots number a shard's
    rows from 0 without gaps, by running totals over hashed ranges: repeated ids and a shard with most rows are no
    burden on one task. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id").cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"),
        (shard_of(key, more) if more else F.lit(None).cast("int")).alias("grown_shard"),
        F.lit(1).cast("long").alias("_one"),
    )
    rows = rows.withColumn("_row", F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()))
    slots = common.running_total(common.stored(rows, "shards"), ["shard"], ["_row"], "_one", "slot")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")
