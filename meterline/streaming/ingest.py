"""Messages to the landing table, exactly once per (topic, partition, offset)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterline.functions import exprs
from meterline.operators.ingest import decode_messages, first_deliveries, land_decoded, rejected
from meterline.schemas import LANDING, MESSAGE, MESSAGE_KEY
from meterline.sources.tables import table_exists

FLUSH_INTERVAL = "2 seconds"


def start(
    messages: DataFrame,
    write_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = False,
    interval: str = FLUSH_INTERVAL,
) -> StreamingQuery:
    """Run ``write_batch`` on every micro-batch: every ``interval``, or until the source is drained.

    Offsets are committed after the batch is written, so a failure replays the batch.
    """
    writer = messages.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def landing_writer(landing_path: str, rejects_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch function: decode, sanitize, drop what was landed before, append."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        decoded = decode_messages(_dealt(batch)).persist()
        try:
            ranges = _offset_ranges(decoded)
            append_new(land_decoded(decoded), landing_path, ranges)
            if rejects_path is not None:
                append_rejects(rejected(decoded), rejects_path, ranges)
        finally:
            decoded.unpersist()

    return write


def _dealt(batch: DataFrame) -> DataFrame:
    """Messages dealt evenly over the tasks by what :data:`MESSAGE_KEY` is made of, as text: a few large files would be
    decoded by a few tasks, and the landed rows would be shuffled as whole events. One task a core: each writes a file per
    partition."""
    tasks = batch.sparkSession.sparkContext.defaultParallelism
    return batch.repartition(tasks, F.col("topic"), F.expr("coalesce(partition, 0)"), F.expr("coalesce(offset, 0L)"))


def _offset_ranges(batch: DataFrame) -> list[Row]:
    """Lowest and highest offset per topic and partition: one row per broker partition."""
    return (
        batch.groupBy("topic", "partition")
        .agg(*exprs("min(offset) AS low", "max(offset) AS high"))
        .collect()
    )


def _in_ranges(ranges: list[Row], topic: str, partition: str, offset: str) -> Column:
    """Rows that a batch may repeat. Missing origins count as values of their own."""
    wanted = F.lit(False)
    for r in ranges:
        inside = F.col(offset).isNull() if r["low"] is None else F.col(offset).isNull() | F.col(offset).between(r["low"], r["high"])
        wanted = wanted | (F.col(topic).eqNullSafe(r["topic"]) & F.col(partition).eqNullSafe(r["partition"]) & inside)
    return wanted


def append_new(rows: DataFrame, path: str, ranges: list[Row]) -> None:
    """Append landing rows that the table does not hold yet.

    A replay can only repeat offsets from the batch's own ``ranges``, so just those are read from the
    table: topic and partition are folders, and row-group statistics on the offset skip the rest.
    """
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(MESSAGE_KEY)
    if ranges and table_exists(spark, path):
        wanted = F.lit(False)
        for r in ranges:
            wanted = wanted | (
                (F.col("kafka_topic") == r["topic"])
                & (F.col("kafka_partition") == r["partition"])
                & F.col("kafka_offset").between(r["low"], r["high"])
            )
        fresh = first_deliveries(rows, read_landing(spark, path).where(wanted))
    _append(fresh, path)


def append_rejects(rows: DataFrame, path: str, ranges: list[Row]) -> None:
    """Keep undecodable messages, also once each; like landed ones they are only compared with the batch's own offsets.

    A message without an offset is told by its text as well, and missing values equal each other.
    """
    keys = ["topic", "partition", "offset", "_text"]
    text = F.when(F.col("offset").isNull(), F.col("value"))
    fresh = rows.withColumn("_text", text).dropDuplicates(keys)
    if ranges and table_exists(rows.sparkSession, path):
        held = read_rejects(rows.sparkSession, path).where(_in_ranges(ranges, "topic", "partition", "offset"))
        held = held.withColumn("_text", text).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
        fresh = fresh.join(held, same, "left_anti")
    fresh.drop("_text").sortWithinPartitions("topic", "partition", "offset").write.mode("append").parquet(path)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).parquet(path)


def _append(rows: DataFrame, path: str) -> None:
    (
        rows.sortWithinPartitions(*MESSAGE_KEY)
        .write.mode("append")
        .partitionBy("kafka_topic", "kafka_partition")
        .parquet(path)
    )


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDING).parquet(path)
