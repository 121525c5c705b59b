"""The corpus pipeline: documents to packed token rows, one stored table per stage.

Order: quality rules, near duplicates, benchmark passages, mix of sources, packing. Each stage works on all that its
predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import common, decontaminate, fertility, minhash, mixing, packing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's fertility bands.

    Null and empty texts fail; equal rows fare alike; an empty table stays empty. All columns come back unchanged, those
    with the name of a measure too.
    """
    hidden = {c: c if c in ("text", "lang") else f"_column_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()])
    return fertility.quality(named).where("kept").select(*[F.col(h).alias(c) for c, h in hidden.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest doc_id of a group stays. A document is its doc_id and text: of an id with several texts only those go
    that are near a smaller id, and rows that repeat both go or stay together. Null ids and texts without words stay; an
    empty table stays empty; other columns are carried.
    """
    labels = minhash.near_duplicates(docs, percent=80)
    dropped = labels.where("not kept").select(F.col("doc_id").alias("_of_id"), F.col("of_text").alias("_of_text")).distinct()
    same = (docs["doc_id"].cast("long") == dropped["_of_id"]) & (F.xxhash64(docs["text"].cast("string")) == dropped["_of_text"])
    return docs.join(dropped, same, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts stay, equal rows fare alike, an empty table or benchmark changes nothing, columns are carried.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and empty texts have no words and are not taken; null sources form one; of equal rows as many are taken as the
    mix draws; an empty table stays empty; columns are carried.
    """
    return mixing.mixed_documents(docs)


def packed_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token rows; null and empty texts have none, equal rows are packed each, other columns are ignored."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix),
    ("packed_rows", packed_rows),
]

#: Sketches, tokenisers and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
