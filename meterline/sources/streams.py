"""Message streams and batches with one common schema (see ``schemas.MESSAGE``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.schemas import MESSAGE


def kafka_options(
    servers: str, topic: str, max_offsets: int | None = None, **extra: str
) -> dict[str, str]:
    """Reader options: start at the earliest offset; ``max_offsets`` bounds a batch. Offsets live in the checkpoint."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }
    if max_offsets is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return {**options, **extra}


def as_messages(source: DataFrame) -> DataFrame:
    """Broker rows (binary key and value) -> the message schema."""
    return source.select(*[F.col(f.name).cast(f.dataType) for f in MESSAGE.fields])


def read_kafka_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return as_messages(spark.readStream.format("kafka").options(**options).load())


def read_message_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages that arrive as Parquet files in a folder."""
    reader = spark.readStream.schema(MESSAGE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Publish encoded messages (``key``, ``value``) and wait for all replicas."""
    (
        messages.select("key", "value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("topic", topic)
        .save()
    )
